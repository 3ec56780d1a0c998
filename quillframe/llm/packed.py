"""Questions and answers between blocks of text and partitions of hashes.

Operators that compare every window of every text can't afford a row for each window.
Here documents are packed into blocks of about 2 MB (``pack``).  A block *asks*: it
sends each hash partition one packed array of its distinct hashes.  The partition
*answers* with a bit string in the order asked, so no positions travel.  ``meet`` brings
a block and its answers together again.  As a block names each distinct hash once, the
cost of a hash that occurs in a third of all rows is one entry per block: no hot keys.

Blocks are numbered by (partition, counter) of the task that packed them and stored in the
shared folder as a table bucketed by that number (null and empty texts take no room, repeated rows
lie each by itself, other columns are kept as they are, an empty table has no blocks, and a text
longer than a block is one of its own).  Texts so move once, when packed; later
only answers move, to the buckets of their blocks.  Whatever is lost later is read again
with the same numbers.

Blocks times partitions is the number of messages.  Both would grow with the corpus, so beyond ``UNIT`` stored
bytes blocks grow with the square root of its size, and partitions, a few blocks' share each, with them:
a message keeps its length, messages grow as the corpus does, and a task's memory as the root (100 TB: blocks
of 114 MB).  Buckets follow the size of what is packed, up to the most that Spark allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import BLOCK, U64, delete, release, shared_dir, shuffle_parts, store, stored_bytes, tasks_for, text_blocks

ROWS = "part int, block long, body binary"
UNIT = 32 << 30
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def parse(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(body)) as stream:
        return stream.read_next_batch()


def rows(parts: Iterable[int], blocks: Iterable[int], bodies: Iterable[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "block", "body"])


class Texts:
    """A block's batch with the bytes and offsets of its texts, and keys that order its documents."""

    def __init__(self, batch: pa.RecordBatch):
        ((self.batch, self.buf, self.offs),) = list(text_blocks([batch], limit=1 << 62)) or [(batch, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        self.ids = np.array([-(1 << 63) if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)

    @cached_property
    def raw(self) -> list[bytes]:
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)]

    @cached_property
    def sums(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(r) for r in self.raw), U64, len(self.raw))


def block_size(stored: int) -> int:
    """Bytes of text a block, of a corpus of that many stored bytes."""
    return int(BLOCK * max(1.0, stored / UNIT) ** 0.5)


def _filled(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have limit bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Packed:
    """A stored table (block, body) of docs; form(batch, its texts' bytes, their offsets) makes a body that ``parse`` reads."""

    def __init__(self, docs: DataFrame, name: str, form: Callable[..., bytes] = lambda batch, *_: dump(batch)):
        self.spark = spark = docs.sparkSession
        release(spark)
        self.path = shared_dir(spark, name)
        self.name = "quillframe_" + self.path.rpartition("-")[2]
        n = min(tasks_for(docs), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        limit = block_size(stored_bytes(docs))

        def run(batches):
            top = TaskContext.get().partitionId() << 32
            k = 0
            for block in text_blocks(_filled(batches, limit), limit=limit):
                yield pa.RecordBatch.from_arrays([pa.array([top + k], pa.int64()), pa.array([form(*block)], pa.binary())], names=["block", "body"])
                k += 1

        blocks = docs.mapInArrow(run, "block long, body binary").repartition(n, "block")
        blocks.write.format("parquet").option("path", self.path).option("compression", "zstd").bucketBy(n, "block").sortBy("block").saveAsTable(self.name)
        self.frame = spark.table(self.name)

    def drop(self) -> None:
        """Once nothing reads it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


pack = Packed


def partitions(table: Packed, blocks_each: float = 8) -> int:
    """Hash partitions: as many as keep a partition's share at that of a few blocks, however many blocks there are."""
    return max(shuffle_parts(table.spark), int(table.frame.count() / blocks_each))


def cut(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Of ascending hashes: where each partition begins, one more at the end."""
    part = ((hashes >> U64(32)) * U64(parts)) >> U64(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(U64))


def ask(met: Packed | tuple[Packed, DataFrame], question: Callable, parts: int, of: Callable = Texts) -> DataFrame:
    """question(of(batch), answers) yields (partition, body)."""

    def send(groups):
        for block, body, answers in groups:
            got = list(question(of(parse(body)), answers))
            if got:
                yield rows([p for p, _ in got], [block] * len(got), [b for _, b in got])

    return meet(*(met if isinstance(met, tuple) else (met, None)), send, ROWS)


def _by_part(batches) -> Iterator[list[tuple[int, int, bytes]]]:
    """Consecutive rows of one part (they come sorted by it)."""
    held: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("part", "block", "body")), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def answer(asked: DataFrame, reply: Callable, parts: int, name: str, shift: int = 0, sums: int | None = None) -> DataFrame:
    """reply(bodies) gives one body for each, in order; stored with part + shift.

    With ``sums`` it also gives (key, x, y) of the partition, stored with part = sums.
    """

    def run(batches):
        for group in _by_part(batches):
            if sums is not None:
                got, more = reply([x for _, _, x in group])
                yield rows([p + shift for p, _, _ in group], [b for _, b, _ in group], got)
                yield rows([sums] * len(more), [k for k, _, _ in more], [np.array(xy, "<f8").tobytes() for _, *xy in more])
                continue
            yield rows([p + shift for p, _, _ in group], [b for _, b, _ in group], reply([x for _, _, x in group]))

    return store(asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block").mapInArrow(run, ROWS), name)


def meet(table: Packed, answers: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    """run(groups of (block, body of the block, {part: answer})) yields batches.

    The blocks stay in their buckets; the answers of a block, at most one a partition
    asked, are shuffled to it.
    """

    answered = answers is not None

    def groups(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                got = row.column("answers").to_pylist()[0] if answered else None
                yield row.column("block")[0].as_py(), row.column("body")[0].as_py(), {a["part"]: a["body"] for a in got or ()}

    both = table.frame
    if answered:
        both = both.join(answers.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("answers")), "block", "left").select("block", "body", "answers")
    return both.mapInArrow(lambda batches: run(groups(batches)), schema)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).view(bool)


class Distinct:
    """The distinct values of an array in ascending order, and where they are."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values)
        ordered = values[self.order]
        self.new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, bool)
        self.at = np.flatnonzero(self.new)
        self.values = ordered[self.at]
        self.size = np.diff(np.append(self.at, len(values)))

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """A value for each distinct one, back to the places of the array."""
        out = np.empty(len(self.order), flags.dtype)
        out[self.order] = np.repeat(flags, self.size)
        return out
