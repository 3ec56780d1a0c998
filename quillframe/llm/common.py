"""Shared pieces: shared storage, Arrow text blocks, vectorised word hashing.

All byte work is done on blocks of about ``BLOCK`` bytes of UTF-8 so that the
memory of a Python worker does not depend on partition or batch sizes.  A single
text longer than that is a block of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quillframe.shipping import ship

BLOCK = 2 << 20
U64 = np.uint64


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where that is unset, a local one if the master is local (tests); on a cluster an error, as
    executors don't share their local folders.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    made = f"{base.rstrip('/')}/quillframe-{name}-{uuid.uuid4().hex}"
    _made.append(made)
    return made


_made: list[str] = []  # folders of this driver


def clear(spark: SparkSession) -> None:
    """Delete all that the operators stored and didn't delete themselves.

    Their results read it, so call this once those are written.
    """
    for t in spark.catalog.listTables():
        if t.name.startswith("quillframe_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    for folder in _made:
        delete(spark, folder)
    _made.clear()


def store(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage so that lost executors cost only their own tasks."""
    spark = df.sparkSession
    if free:
        release(spark)  # of the steps before
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``store`` that nothing reads any more."""
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "quillframe-" in top:
            delete(df.sparkSession, top)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced.

    The cleaner learns of them from the collector of the driver's JVM alone, which may not run for
    hours where the driver does little; a long job would then hold the shuffles of all its steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


TASK_BYTES = 128 << 20  # of what is stored, a task
_UNKNOWN = 1 << 62


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by Catalyst's statistics (nothing runs); rows that lie in no file count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(x for x in sizes if x < _UNKNOWN)


def tasks_for(df: DataFrame) -> int:
    """Partitions for all rows of df: as many as the session has for a shuffle, more where df reads more than they bear."""
    return max(shuffle_parts(df.sparkSession), -(-stored_bytes(df) // TASK_BYTES))


# ---------------------------------------------------------------- text blocks


def _text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(kind)
    if col.null_count:
        col = col.fill_null(b"" if kind == pa.large_binary() else "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs


def text_blocks(batches, column: str = "text", limit: int = BLOCK):
    """(rows of the block, their UTF-8 bytes end to end, n+1 offsets); null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = _text_buffers(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


# ------------------------------------------------------------------- hashing

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15  # odd; its powers and their inverses modulo 2^64 are tabled
_RI = pow(_R, -1, 1 << 64)
_STEP = 1 << 16
_POW: dict[tuple[int, int], np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """At least n powers of base."""
    key, size = (base, 0), _STEP
    if n > size:
        size = 1 << (n - 1).bit_length()
    have = _POW.get(key)
    if have is None or len(have) < size:
        out = np.empty(size, U64)
        out[0] = 1
        k = 1
        while k < size:
            out[k : 2 * k] = out[:k] * U64(pow(base, k, 1 << 64))
            k *= 2
        _POW[key] = have = out
    return have


def _power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base to the power of each of at, from two small tables."""
    out = _table(base, _STEP)[at & (_STEP - 1)]
    if len(at) and (top := int(at.max()) >> 16):
        out = out * _table(pow(base, _STEP, 1 << 64), top + 1)[at >> 16]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_R))  # a 64-bit code for each byte value


def prefix_sums(values: np.ndarray, codes: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Prefix sums of value (or its code) * R^position, from which every span's hash follows by one subtraction."""
    n = len(values)
    out = np.empty(n + 1, U64) if out is None else out
    out[0] = 0
    powers = _table(_R, _STEP)
    for i in range(0, n, _STEP):
        part = out[i + 1 : i + 1 + _STEP]
        own = values[i : i + len(part)]
        np.multiply(own if codes is None else codes[own], powers[: len(part)], out=part)
        if i:
            part *= U64(pow(_R, i, 1 << 64))
        np.cumsum(part, out=part)
        part += out[i]
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _power_at(_RI, start))


def window_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """span_hash of every window of k."""
    out = sums[k:] - sums[:-k]
    inverse = _table(_RI, _STEP)
    for i in range(0, len(out), _STEP):
        part = out[i : i + _STEP]
        part *= inverse[: len(part)]
        if i:
            part *= U64(pow(_RI, i, 1 << 64))
    return mix(out)


def _chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b), in this order."""
    return mix(a * U64(_R) + b)


_LONG = 512  # bytes of a word that are hashed eight at a time
_LANE = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], U64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes after the other, each mixed in; no sum, so no pattern of bytes cancels out."""
    size = end - start
    out = mix(size.astype(U64) + U64(_R))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))
    long = np.flatnonzero(size > _LONG)
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = start[live], size[live]
    while len(live):
        out[live] = _chain(out[live], lanes[at] & _LANE[np.minimum(left, 8)])
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]])
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, by doubling: pairs, pairs of pairs ..."""
    out, step, power = None, 1, values
    while True:
        if k & step:
            out = power[: len(values) - step + 1] if out is None else _chain(power[: len(out) - step], out[step:])
        if 2 * step > k:
            return out
        power = _chain(power[: len(power) - step], power[step:])
        step *= 2


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for a, b in spans:
        out[a : b + 1] = False
    return out


#: Bytes of words: [^\x20\x09-\x0D]+, and letters, digits and what is not ASCII.
WORD_BYTES = byte_table((0x20, 0x20), (0x09, 0x0D))
ALNUM_BYTES = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a block: byte spans, per-document counts and 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD_BYTES, hashed: bool = True):
        n = len(buf)
        self.buf, self.offs = buf, offs
        inside = table[buf]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)  # of each document: its first word; one more at the end
        self.count = np.diff(self.first)
        if hashed:
            self.hash = word_hashes(buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) of all k-word windows within a document, and their hashes (others for another seed)."""
        m = len(self)
        if m < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        last = np.repeat(self.first[1:], self.count)
        at = np.flatnonzero(np.arange(m) + k <= last)
        return at, gram_hashes(mix(self.hash ^ U64(seed)) if seed else self.hash, k)[at]

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Hashes of all words of each of docs, which have few."""
        out = mix(self.count[docs].astype(U64))
        for j in range(int(self.count[docs].max(initial=0))):
            live = np.flatnonzero(self.count[docs] > j)
            out[live] = _chain(out[live], self.hash[self.first[docs[live]] + j])
        return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the positions in [start, start + width) of any of the distinct starts."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] = 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def sliding_min_at(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the position of its rightmost minimum (by all but the lowest bits, where positions are kept)."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    low = U64((1 << max(24, n.bit_length())) - 1)
    best = (values & ~low) | (low - np.arange(n, dtype=U64))
    step = 1
    while step * 2 <= w:
        best = np.minimum(best[: len(best) - step], best[step:])
        step *= 2
    rest = w - step
    best = np.minimum(best[: n - w + 1], best[rest : rest + n - w + 1])
    return (low - (best & low)).astype(np.int64)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
