"""Operator 8: byte-level BPE by a contiguous rank array.

A short word holds its parts side by side and the merge rank of every adjacent
pair.  The minimum is looked for again and again; the boundary there is deleted and
the two neighbouring ranks are refreshed.  Words of one length are done together, a
row each, so the scans are array operations; words over ``SHORT`` bytes use a heap
over linked parts instead, which is not quadratic.  Each worker remembers the ids
of the chunks it has seen.

Null texts are empty: no ids, empty decoding.  Every text decodes to itself.  Repeated rows get
a row each, whatever their ids; an empty table gives none; a very long text is a row of one task.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

from quillframe.shipping import ship

SHORT = 96
MEMO = 300_000  # chunks remembered by a worker, about 80 MB
NONE = np.int32(2**31 - 1)

#: White space as the tokenizer's regular expressions see it, and its split pattern on ASCII: fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{SPACE}A-Za-z0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankBpe:
    def __init__(self, path: str):
        import re

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        names = printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece = {i: bytes(names[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.piece |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in names.items():
            self.byte_id[b] = vocab[c]
        self.size = max(self.piece) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.chunk = re.compile(CHUNK)
        self.word = re.compile(WORD)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) * self.size + right
        want[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> list[np.ndarray]:
        """parts: a row of byte ids for each word of one length; returns each word's ids."""
        n, width = parts.shape
        parts = np.concatenate([parts, np.full((n, 1), -1, np.int32)], axis=1)
        length = np.full(n, width)
        ranks = np.full((n, width), NONE, np.int32)  # ranks[:, k]: of parts k and k + 1
        if width > 1:
            ranks[:, :-1] = self.rank(parts[:, : width - 1].ravel(), parts[:, 1:width].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        column = np.arange(width)
        while len(live):
            at = ranks[live].argmin(1)
            low = ranks[live, at]
            keep = low != NONE
            live, at, low = live[keep], at[keep], low[keep]
            if not len(live):
                break
            p, r = parts[live], ranks[live]
            gone = column >= (at + 1)[:, None]  # delete the boundary behind part `at`: what follows moves up
            p[:, :width] = np.where(gone, p[:, 1:], p[:, :width])
            r[:, :-1] = np.where(gone[:, 1:] | (column[:-1] == at[:, None]), r[:, 1:], r[:, :-1])
            r[:, -1] = NONE
            row = np.arange(len(live))
            p[row, at] = self.merged[low]
            r[row, at] = self.rank(p[row, at], p[row, at + 1])
            back = np.flatnonzero(at > 0)
            r[back, at[back] - 1] = self.rank(p[back, at[back] - 1], p[back, at[back]])
            parts[live], ranks[live] = p, r
            length[live] -= 1
        return [parts[k, : length[k]] for k in range(n)]

    def merge_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), k, ids[k], ids[k + 1]) for k, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(k: int) -> None:
            j = after[k]
            if j < n:
                r = int(self.rank(np.array([ids[k]]), np.array([ids[j]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, k, ids[k], ids[j]))

        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = int(self.merged[r]), -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            if before[k] >= 0:
                push(before[k])
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.merge_long(w)
            else:
                by_length.setdefault(len(w), []).append(k)
        for length, ks in by_length.items():
            for i in range(0, len(ks), 4096):
                part = ks[i : i + 4096]
                rows = self.byte_id[np.frombuffer(b"".join(words[k] for k in part), np.uint8)].reshape(len(part), length)
                for k, ids in zip(part, self.merge_rows(rows), strict=True):
                    out[k] = ids
        return out

    def library_words(self, chunk: str) -> list[str]:
        """What is a letter or a digit beyond ASCII depends on the version of Unicode: the library's own is asked."""
        return [chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks; each is split into words and the distinct words are merged together."""
        spans = {c: [w.encode() for w in (self.word.findall(c) if c.isascii() else self.library_words(c))] for c in chunks}
        words = list({w for ws in spans.values() for w in ws})
        ids = dict(zip(words, (x.astype("<u4").tobytes() for x in self.encode_words(words)), strict=True))
        for c, ws in spans.items():
            self.memo[c] = b"".join([ids[w] for w in ws])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts: list[list] = []
        for text in texts:
            if self.split is not None and any(s in text for s in self.special):
                row = []
                for p in self.split.split(text):
                    row += [self.special[p]] if p in self.special else self.chunk.findall(p)
                parts.append(row)
            else:
                parts.append(self.chunk.findall(text))
        memo = self.memo
        new = {c for row in parts for c in row if c not in memo}
        new = {c for c in new if c.__class__ is str}
        if new and len(memo) + len(new) > MEMO:
            memo.clear()
            new = {c for row in parts for c in row if c.__class__ is str}
        if new:
            self.learn(new)
        return [b"".join([memo[c] if c.__class__ is str else np.array([c], "<u4").tobytes() for c in row]) for row in parts]

    def decode(self, ids: bytes) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, RankBpe] = {}


def tokenizer(path: str) -> RankBpe:
    if path not in _loaded:
        _loaded[path] = RankBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, group: int = 256, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the decoded text; with_ids: the ids too.  One pass, no shuffle."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, group):
                part = batch.slice(k, group)
                coded = bpe.encode_many([t or "" for t in part.column(1).to_pylist()])
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded]),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)
        pa.default_memory_pool().release_unused()

    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
