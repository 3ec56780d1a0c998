"""Operator 6: repeated passages of words, found by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``window // 2`` words of every document;
any passage of ``window`` words holds one whole.  They are indexed by hash, and every
rolling window of as many words of every document probes the index (both travel as the
packed questions of ``packed``).  A probe that meets a block, where the words occur twice or
more, is an anchor.  Anchors are extended to every ``window``-word passage that holds one;
equal passages (96 bits of two hashes) meet again, the earliest keeps its words and all later ones
lose theirs, and neighbouring passages run on, so the removed runs are the maximal exact repeats.
No pair of occurrences is followed word by word: a block that a third of all documents share has
too many of them.

Order: smaller doc_id first (null before all), then smaller hash of the text; rows equal in
both are one document given several times and are treated alike.  Null texts have no words.
Texts under ``window`` words keep everything.  An empty table gives no rows; a very long text is
a block of its own, in the memory of one task; an id of -2^63 is taken for null.  ``without_repeats``
keeps all columns, whatever their names; the digests ignore those but doc_id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm.common import U64, Words, cover, runs
from quillframe.llm.packed import Distinct, Texts, answer, ask, bits, cut, meet, pack, parse, partitions, unbits

WINDOW, SEED = 20, 0xD6E8FEB86659FD93
_HIGH = np.dtype([("low", "<u4"), ("high", "u1")])


def _anchors(words: Words, k: int):
    """All k-word probes of a block: starts, distinct hashes, and which distinct hash is a reference block."""
    at, h = words.windows(k)
    d = Distinct(h)
    inside = at - np.repeat(words.first[:-1], words.count)[at]
    block = np.logical_or.reduceat((inside % k == 0)[d.order], d.at) if len(at) else np.zeros(0, bool)
    return at, d, block


class _Passages:
    """The window-word passages of a block that hold an anchor, with their order inside the block."""

    def __init__(self, t: Texts, words: Words, window: int, k: int, parts: int, answers: dict[int, bytes]):
        at, d, _ = _anchors(words, k)
        ends = cut(d.values, parts)
        hot = np.zeros(len(d.values), bool)
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            hot[ends[p] : ends[p + 1]] = unbits(answers[p], int(ends[p + 1] - ends[p]))
        flags = np.zeros(len(words) + 1, np.int64)
        flags[1:][at] = d.spread(hot)
        held = np.cumsum(flags)
        start, high = words.windows(window)
        low = words.windows(window, SEED)[1]
        want = held[start + window - k + 1] > held[start]
        self.start, self.high, self.low = start[want], high[want], (low[want] >> U64(32)).astype("<u4")
        doc = np.searchsorted(words.first, self.start, "right") - 1
        place = self.start - words.first[doc]
        order = np.lexsort((t.sums, t.ids))
        same = np.concatenate(([False], (t.ids[order][1:] == t.ids[order][:-1]) & (t.sums[order][1:] == t.sums[order][:-1])))[: len(order)]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(~same) - 1
        rank = rank[doc]
        self.order = np.lexsort((place, rank, self.low, self.high))
        h, lo = self.high[self.order], self.low[self.order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])))[: len(h)]
        self.at = np.flatnonzero(new)
        self.size = np.diff(np.append(self.at, len(h)))
        first = self.order[self.at]
        self.key_high, self.key_low, self.doc = self.high[first], self.low[first], doc[first]
        #: occurrences at the same place of the same document as the block's first one
        lead = np.repeat(first, self.size)
        self.leads = (rank[self.order] == rank[lead]) & (place[self.order] == place[lead])


def repeats(docs: DataFrame, window: int, run, schema: str) -> DataFrame:
    """run(Texts, Words, flags of the words of later repeats) yields a batch for each block."""
    k = window // 2
    table = pack(docs, "anchors-docs")
    parts = partitions(table)

    def probes(t: Texts, _):
        _, d, block = _anchors(Words(t.buf, t.offs), k)
        ends = cut(d.values, parts)
        low = np.empty(len(d.values), _HIGH)
        low["low"], low["high"] = d.values & U64(0xFFFFFFFF), (d.values >> U64(32)) & U64(0xFF)
        several = d.size > 1
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            a, b = ends[p], ends[p + 1]
            yield p, np.array([b - a], "<u4").tobytes() + low[a:b].tobytes() + bits(np.concatenate([block[a:b], several[a:b]]))

    def look_up(bodies: list[bytes]) -> list[bytes]:
        counts = [int(np.frombuffer(x, "<u4", 1)[0]) for x in bodies]
        keys, block, several = [], [], []
        for n, x in zip(counts, bodies, strict=True):
            pairs = np.frombuffer(x, _HIGH, n, 4)
            keys.append(pairs["low"].astype(U64) | (pairs["high"].astype(U64) << U64(32)))
            flags = unbits(x[4 + 5 * n :], 2 * n)
            block.append(flags[:n])
            several.append(flags[n:])
        d = Distinct(np.concatenate(keys))
        hot = np.logical_or.reduceat(np.concatenate(block)[d.order], d.at) & ((d.size > 1) | np.logical_or.reduceat(np.concatenate(several)[d.order], d.at))
        flags, ends = d.spread(hot), np.cumsum([0, *counts])
        return [bits(flags[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    anchors = answer(ask(table, probes, parts), look_up, parts, "anchors")

    def passages(t: Texts, answers):
        x = _Passages(t, Words(t.buf, t.offs), window, k, parts, answers)
        ends = cut(x.key_high, parts)
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            own = slice(ends[p], ends[p + 1])
            docs, at = np.unique(x.doc[own], return_inverse=True)
            head = np.array([len(at), len(docs)], "<u4").tobytes()
            yield p, b"".join([head, x.key_high[own].tobytes(), x.key_low[own].tobytes(), at.astype("<u4").tobytes(), t.ids[docs].tobytes(), t.sums[docs].tobytes()])

    def earliest(bodies: list[bytes]) -> list[bytes]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        counts = []
        for x in bodies:
            n, m = np.frombuffer(x[:8], "<u4").tolist()
            counts.append(n)
            at = np.frombuffer(x, "<u4", n, 8 + 12 * n)
            cols[0].append(np.frombuffer(x, U64, n, 8))
            cols[1].append(np.frombuffer(x, "<u4", n, 8 + 8 * n))
            cols[2].append(np.frombuffer(x, np.int64, m, 8 + 16 * n)[at])
            cols[3].append(np.frombuffer(x, U64, m, 8 + 16 * n + 8 * m)[at])
        high, low, ids, sums = (np.concatenate(c) for c in cols)
        order = np.lexsort((sums, ids, low, high))
        h, lo = high[order], low[order]
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]))))
        lead = np.repeat(order[at], np.diff(np.append(at, len(h))))
        flags = np.empty(len(h), bool)
        flags[order] = (ids[order] == ids[lead]) & (sums[order] == sums[lead])
        ends = np.cumsum([0, *counts])
        return [bits(flags[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    firsts = answer(ask((table, anchors), passages, parts), earliest, parts, "passages", shift=parts)

    def apply(groups):
        for _, body, answers in groups:
            t = Texts(parse(body))
            words = Words(t.buf, t.offs)
            x = _Passages(t, words, window, k, parts, {p: a for p, a in answers.items() if p < parts})
            ends = cut(x.key_high, parts)
            keeps = np.zeros(len(x.key_high), bool)
            for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                keeps[ends[p] : ends[p + 1]] = unbits(answers[parts + p], int(ends[p + 1] - ends[p]))
            later = x.order[~(np.repeat(keeps, x.size) & x.leads)]
            yield run(t, words, cover(x.start[later], window, len(words)))

    return meet(table, anchors.unionByName(firsts), apply, schema)


def passage_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the removed byte spans of the text."""

    def run(t: Texts, words: Words, flags: np.ndarray) -> pa.RecordBatch:
        sums, removed, spans = [], [], []
        for d, raw in enumerate(t.raw):
            f = flags[words.first[d] : words.first[d + 1]]
            kept = raw.split()
            if f.any():
                kept = [w for w, x in zip(kept, f.tolist(), strict=True) if not x]
            removed.append(int(f.sum()))
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append(_spans(words, d, f, t.offs[d]))
        return pa.RecordBatch.from_arrays([t.batch.column("doc_id").cast(pa.int64()), pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return repeats(docs.select("doc_id", "text"), window, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>")


def _spans(words: Words, d: int, f: np.ndarray, base: int) -> list[list[int]]:
    a, b = runs(f)
    first = words.first[d]
    return [[int(words.start[first + x] - base), int(words.end[first + y - 1] - base)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the later repeats cut out of ``text``; the other columns as they are."""
    schema = docs.schema
    names = schema.names

    def run(t: Texts, words: Words, flags: np.ndarray) -> pa.RecordBatch:
        texts = t.batch.column("text").to_pylist()
        for d in np.unique(np.searchsorted(words.first, np.flatnonzero(flags), "right") - 1).tolist():
            raw, at, kept = t.raw[d], 0, []
            for a, b in _spans(words, d, flags[words.first[d] : words.first[d + 1]], t.offs[d]):
                kept.append(raw[at:a].rstrip(b" \t"))
                at = b
            texts[d] = b"".join([*kept, raw[at:]]).decode()
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else t.batch.column(n) for n in names], names=names)

    return repeats(docs, window, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
