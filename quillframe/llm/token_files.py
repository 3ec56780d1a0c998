"""Operator 1: token-ID files of independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames in the public seekable layout:

* one frame per document: its ids as little-endian integers of 2 bytes (vocabulary
  up to 65,536 ids) or 4 bytes, so a reader decompresses only what is asked for;
* a skippable frame (magic 0x184D2A50): width, then the doc_ids and token counts;
* the seek table, a skippable frame (magic 0x184D2A5E) with for every frame its
  compressed size, decompressed size and checksum (low 32 bits of XXH64 of the
  decompressed data), and a footer with the number of frames, descriptor 0x80 and
  the magic 0x8F92EAB1.

Null doc_ids are written as the smallest 64-bit integer and read back as null.
Null and empty texts hold the end id only.  Repeated rows are written once each;
equal doc_ids are ordered by text.  An empty table makes no files and no rows.
Extra columns are not read.
"""

from __future__ import annotations

import binascii
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.llm.common import shared_dir, shuffle_parts, tasks_for
from quillframe.llm.rank_bpe import printable_bytes

INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
MEMO = 800_000  # words whose ids a worker remembers


class ChunkEncoder:
    """The library's ids of a text, remembered by white-space separated chunk.

    Valid for tokenizers that lower-case, drop white space, never look across it, and
    never put a letter and the full stop or comma behind it into one piece.
    """

    #: Whole texts go to the library where str.split() and str.lower() might differ from it,
    #: marks could be composed after lower-casing only, or special tokens begin.
    _odd = re.compile("[\x1c-\x1f\u0130\u03a3\u0300-\u036f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.model, self.names = self.lib.model, {b: c for c, b in printable_bytes().items()}
        self.direct = True
        self.direct = all(self._letters(w) == self.lib.encode(w, add_special_tokens=False).ids for w in ("a", "words", "thereupon", "été", "straße", "ñandú"))

    def _pack(self, ids) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _letters(self, word: str) -> list[int] | None:
        """Of a lower-case word of plain letters: straight from the library's model, as normaliser and splitter leave it whole."""
        if not self.direct or not word.isalpha():
            return None
        if not word.isascii():
            if ord(max(word)) >= 0x250 or not unicodedata.is_normalized("NFC", word):
                return None
            word = word.encode().decode("latin-1").translate(self.names)
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, words: list[str], new: set[str]) -> None:
        memo = self.memo
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {*words}
        ended = [w for w in new if w[-1] in ".," and len(w) > 1 and w[-2].isalpha()]
        new.difference_update(ended)
        new.update([w[:-1] for w in ended], ".,")
        rest = []
        for w in new:
            if w not in memo:
                ids = self._letters(w)
                if ids is None:
                    rest.append(w)
                else:
                    memo[w] = self._pack(ids)
        for w, e in zip(rest, self.lib.encode_batch(rest, add_special_tokens=False), strict=True):
            memo[w] = self._pack(e.ids)
        for w in ended:
            memo[w] = memo[w[:-1]] + memo[w[-1]]

    def __call__(self, text: str) -> bytes:
        if "<|" in text or self._odd.search(text):
            return self._pack(self.lib.encode(text, add_special_tokens=False).ids)
        words, memo = text.lower().split(), self.memo
        new = {*words}.difference(memo)
        if new:
            self._learn(words, new)
        return b"".join([memo[w] for w in words])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class FrameWriter:
    def __init__(self, sink, width: int, level: int = 3):
        self.sink, self.width, self.table, self.ids, self.counts = sink, width, [], [], []
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.sink.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)

    def close(self) -> None:
        body = struct.pack("<IQ", self.width, len(self.ids)) + np.asarray(self.ids, "<i8").tobytes() + np.asarray(self.counts, "<u4").tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        rows = [*self.table, (len(body) + 8, 0, 0)]
        table = np.asarray(rows, "<u4").tobytes()
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(rows), 0x80, FOOT_MAGIC))
        self.sink.close()


class FrameReader:
    """Random access to the documents of one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.sizes, self.sums = table[:, 1], table[:, 2]
        body = self._at(int(self.starts[n - 1]) + 8, int(table[-1, 0]) - 8)
        self.width, count = struct.unpack("<IQ", body[:12])
        self.doc_ids = np.frombuffer(body[12 : 12 + 8 * count], "<i8")
        self.counts = np.frombuffer(body[12 + 8 * count :], "<u4")
        self.open = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int, frame: bytes | None = None) -> np.ndarray:
        """Ids of the k-th document; only its own frame is read, and checked."""
        frame = frame if frame is not None else self._at(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))
        ids = self.open.decompress(frame, max_output_size=max(1, int(self.sizes[k])))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of document {k} is wrong")
        return np.frombuffer(ids, f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[np.ndarray]:
        """All documents in order, read some MB at a time."""
        k, n = 0, len(self)
        while k < n:
            m = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + (4 << 20), "right")) - 1)
            m = min(m, n)
            part = self._at(int(self.starts[k]), int(self.starts[m] - self.starts[k]))
            for j in range(k, m):
                yield self.document(j, part[int(self.starts[j] - self.starts[k]) : int(self.starts[j + 1] - self.starts[k])])
            k = m


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = 1) -> list[tuple[str, int]]:
    """Encode ``docs(doc_id, text)`` to files below ``out`` in ascending doc_id order.

    One range shuffle on doc_id; each task writes one file under a name of its own
    attempt and then renames it, so a task that runs again replaces its own file by
    an equal one.  Returns (file, tokens) in order: one small row per file.
    """

    def write(batches):
        fs, top = pafs.FileSystem.from_uri(out)
        fs.create_dir(top, recursive=True)
        enc, task = encoder(tokenizer), TaskContext.get()
        end = enc._pack([end_id])
        name = f"part-{task.partitionId():06d}.tokens.zst"
        writer, total = None, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    writer = FrameWriter(fs.open_output_stream(f"{top}/.{name}.{task.taskAttemptId()}"), enc.width)
                ids = enc(text or "") + end
                total += len(ids) // enc.width
                writer.add(NO_ID if doc_id is None else doc_id, ids)
        if writer is not None:
            writer.close()
            fs.move(f"{top}/.{name}.{task.taskAttemptId()}", f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "tokens": [total]})

    n = tasks_for(docs)
    # the text's beginning behind the id: rows that share an id, or have none, are not one task's
    ranges = [*([n] if n > shuffle_parts(docs.sparkSession) else []), "doc_id", F.substring("text", 1, 64)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*ranges).sortWithinPartitions("doc_id", "text").mapInArrow(write, "file string, tokens long").collect()
    return sorted((r.file, r.tokens) for r in rows)


def read_token_files(spark: SparkSession, out: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files themselves."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, width int"
    base, rows = 0, []
    for name, tokens in files:
        rows.append((name, base))
        base += tokens
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches):
        fs, top = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as source:
                    reader = FrameReader(source)
                    counts = reader.counts.astype(np.int64)
                    crc = np.fromiter((binascii.crc32(x.tobytes()) for x in reader), np.int64, len(reader))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crc), pa.array(np.full(len(crc), reader.width, np.int32))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "width"],
                    )

    return spark.createDataFrame(rows, "file string, base long").repartition(len(rows), "file").mapInArrow(read, schema)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 1) -> DataFrame:
    out = out or shared_dir(spark, "tokens")
    return read_token_files(spark, out, write_token_files(docs, tokenizer, out, end_id))
