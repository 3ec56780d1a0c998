"""Operator 2: repeated byte strings across a corpus, by suffix sorting of shards.

Every window of ``length`` bytes belongs to the smallest hash of the ``GRAM``-byte grams in
it; windows in a row with one such gram make a stretch.  Equal windows have equal grams, so
they meet in the shard of that gram's hash:

1. blocks ask which of their grams the corpus has twice or more (8-byte hashes cut to 5,
   one an entry and block; see ``packed``); all other stretches are unique and stay home;
   Of grams that more than ``hot`` blocks name, the same is asked of each window's hash, spread over
   all partitions, and only runs of windows that may occur twice go on: text round a popular
   passage, new each time, then makes no shard that grows with the corpus;
2. the other stretches go, as bytes, to the shards of their grams, each distinct one once
   a block.  A shard takes each distinct stretch (by 128-bit digest) once, and whether it came twice, and sorts
   their suffixes by external induction (``induced_sort``); a window is repeated if a
   neighbour shares ``length`` bytes, or if its stretch came twice;
3. blocks get a bit for every window asked about and remove what repeated windows cover.

All comparisons are judged on the input.  Texts are UTF-8; null is empty; matches never cross
documents; repeated rows are documents of their own and so remove each other's bytes.  An
empty table gives no rows; a very long text is a block of its own, in the memory of one task; ids
may be null or repeated, and columns other than doc_id and text are ignored.  A
removal may cut a character in two: ``kept`` is bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from quillframe.llm.common import BYTE_CODE, U64, cover, mix, prefix_sums, runs, sliding_min_at, span_hash, window_hashes
from quillframe.llm.induced_sort import Sorter
from quillframe.llm.packed import Distinct, Texts, answer, ask, bits, cut, meet, pack, parse, partitions, unbits

LENGTH, GRAM = 200, 64
HOT = 32  # blocks: the stretches of a gram that no more of them name are at most their texts
_KEY = np.dtype([("low", "<u4"), ("high", "u1")])


class Stretches:
    """The runs of windows of a block that share their smallest gram."""

    def __init__(self, t: Texts, length: int, gram: int, parts: int):
        n = len(t.buf)
        self.length, self.parts, self.sums = length, parts, np.zeros(1, U64)
        if n < length:
            self.start = self.end = np.zeros(0, np.int64)
            self.key = Distinct(np.zeros(0, U64))
        else:
            self.sums = prefix_sums(t.buf, BYTE_CODE)
            h = window_hashes(self.sums, gram)
            least = sliding_min_at(h, length - gram + 1)
            ok = np.zeros(n - length + 1, bool)
            for a, b in zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True):
                if b - a >= length:
                    ok[a : b - length + 1] = True
            first = ok.copy()
            first[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
            last = ok.copy()
            last[:-1] &= ~ok[1:] | (least[1:] != least[:-1])
            cuts = t.offs[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(ok))]
            first[cuts[ok[cuts]]] = True
            before = cuts - 1
            last[before[ok[before]]] = True
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + length
            self.key = Distinct(mix(h[least[self.start]] + U64(1)))  # smallest hashes are small: mixed again, they spread
        self.ends = cut(self.key.values, parts)

    def shared(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each stretch, whether its gram occurs twice or more, and whether it is hot."""
        flags = np.zeros((2, len(self.key.values)), bool)
        for p in _full(self.ends):
            a, b = self.ends[p], self.ends[p + 1]
            flags[:, a:b] = unbits(answers[p], 2 * int(b - a)).reshape(2, -1)
        return self.key.spread(flags[0]), self.key.spread(flags[1])

    def windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, Distinct, np.ndarray]:
        """The windows of hot stretches: starts, stretches, distinct hashes and where partitions of those begin."""
        k = np.flatnonzero(hot)
        size = self.end[k] - self.start[k] - self.length + 1
        at = np.repeat(self.start[k] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        key = Distinct(span_hash(self.sums, at, at + self.length))
        return at, np.repeat(k, size), key, cut(key.values, self.parts)

    def pieces(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the grams' numbers of what goes to shards: shared stretches, of hot ones the runs of windows that may occur twice."""
        shared, hot = self.shared(answers)
        of = np.empty(len(self.start), np.int64)
        of[self.key.order] = np.repeat(np.arange(len(self.key.values)), self.key.size)
        at, own, key, ends = self.windows(hot)
        again = np.zeros(len(key.values), bool)
        for p in _full(ends):
            again[ends[p] : ends[p + 1]] = unbits(answers[self.parts + p], int(ends[p + 1] - ends[p]))
        again = key.spread(again)
        at, own = at[again], own[again]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        whole = np.flatnonzero(shared & ~hot)
        return np.concatenate([self.start[whole], at[first]]), np.concatenate([self.end[whole], at[last] + self.length]), of[np.concatenate([whole, own[first]])]

    def to_shards(self, t: Texts, answers: dict[int, bytes]):
        """(shard, its distinct stretches, their grams' hashes, which came twice in the block, the starts of each distinct one)."""
        raw = t.buf.tobytes()
        start, end, gram = self.pieces(answers)
        part = np.searchsorted(self.ends, gram, "right") - 1
        order = np.argsort(part, kind="stable")
        start, end, gram, part = (x[order] for x in (start, end, gram, part))
        for p in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, [p, p + 1]).tolist()
            seen: dict[bytes, list[int]] = {}
            grams = []
            for a, b, g in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), gram[lo:hi].tolist(), strict=True):
                places = seen.setdefault(raw[a:b], [])
                if not places:
                    grams.append(g)
                places.append(a)
            yield p, list(seen), self.key.values[grams], np.array([len(v) > 1 for v in seen.values()], bool), list(seen.values())


def _full(ends: np.ndarray) -> list[int]:
    """The partitions that have any."""
    return np.flatnonzero(ends[1:] > ends[:-1]).tolist()


def _named(key: Distinct, ends: np.ndarray):
    """For each partition its distinct hashes, five bytes each, and whether the block has them more than once."""
    low = np.empty(len(key.values), _KEY)
    low["low"], low["high"] = key.values & U64(0xFFFFFFFF), (key.values >> U64(32)) & U64(0xFF)
    for p in _full(ends):
        a, b = ends[p], ends[p + 1]
        yield p, np.array([b - a], "<u4").tobytes() + low[a:b].tobytes() + bits(key.size[a:b] > 1)


def _twice(bodies: list[bytes], hot: int | None = None) -> list[bytes]:
    """Of each hash whether it occurs twice or more and, if asked, whether more than ``hot`` blocks name it."""
    sizes = [int(np.frombuffer(x, "<u4", 1)[0]) for x in bodies]
    pairs = np.concatenate([np.frombuffer(x, _KEY, n, 4) for n, x in zip(sizes, bodies, strict=True)])
    several = np.concatenate([unbits(x[4 + 5 * n :], n) for n, x in zip(sizes, bodies, strict=True)])
    d = Distinct(pairs["low"].astype(U64) | (pairs["high"].astype(U64) << U64(32)))
    flags = [d.spread((d.size > 1) | np.logical_or.reduceat(several[d.order], d.at))]
    if hot is not None:
        flags.append(d.spread(d.size > hot))
    ends = np.cumsum([0, *sizes])
    return [bits(np.concatenate([f[a:b] for f in flags])) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def repeats(docs: DataFrame, run, schema: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """run(Texts, flags of the bytes that repeated strings cover) yields a batch for each block."""
    gram = max(1, min(gram, length - 1))
    table = pack(docs, "suffix-docs")
    parts = partitions(table, blocks_each=3)

    def grams(t: Texts, _):
        s = Stretches(t, length, gram, parts)
        yield from _named(s.key, s.ends)

    def windows(t: Texts, answers):
        s = Stretches(t, length, gram, parts)
        yield from _named(*s.windows(s.shared(answers)[1])[2:])

    known = answer(ask(table, grams, parts), lambda bodies: _twice(bodies, hot), parts, "grams")
    known = known.unionByName(answer(ask((table, known), windows, parts), _twice, parts, "windows", shift=parts))

    def stretches(t: Texts, answers):
        press = zstandard.ZstdCompressor(level=1)
        for p, strings, grams, several, _ in Stretches(t, length, gram, parts).to_shards(t, answers):
            sizes = np.array([len(s) for s in strings], "<u4")
            yield p, press.compress(b"".join([np.array([len(strings)], "<u4").tobytes(), sizes.tobytes(), grams.astype("<u8").tobytes(), bits(several), *strings]))

    def shard(bodies):
        unpress = zstandard.ZstdDecompressor()

        def entries(body: bytes):
            x = unpress.decompress(body)
            n = int(np.frombuffer(x, "<u4", 1)[0])
            sizes = np.frombuffer(x, "<u4", n, 4).astype(np.int64)
            at = 4 + 12 * n
            return x, sizes, np.frombuffer(x, "<u8", n, 4 + 4 * n), unbits(x[at : at + (n + 7) // 8], n), at + (n + 7) // 8 + np.concatenate(([0], np.cumsum(sizes)))

        # of each entry a 128-bit digest, size, gram and flag; the stretches themselves are read again where they go
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for body in bodies:
            x, sizes, grams, several, ends = entries(body)
            sums = b"".join(xxhash.xxh3_128_digest(x[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            for c, v in zip(cols, (np.frombuffer(sums, U64).reshape(-1, 2), sizes, grams.astype(U64), several), strict=True):
                c.append(v)
        of_body = np.cumsum([0, *(len(c) for c in cols[1])])
        sums, sizes, grams, several = (np.concatenate(c) for c in cols)
        cols.clear()
        order = np.lexsort((sums[:, 1], sums[:, 0]))
        new = np.concatenate(([True], (sums[order[1:]] != sums[order[:-1]]).any(axis=1)))
        at = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[at]
        often = (np.diff(np.append(at, len(order))) > 1) | np.logical_or.reduceat(several[order], at)
        # windows of one stretch differ (their gram lies elsewhere in each), so a gram's only distinct stretch has nothing to be sorted against
        d = Distinct(grams[first])
        chosen = np.sort(first[d.spread(d.size > 1)])

        def texts():
            upto = np.searchsorted(chosen, of_body)
            for k, body in enumerate(bodies):
                if upto[k] < upto[k + 1]:
                    x, _, _, _, ends = entries(body)
                    for e in (chosen[upto[k] : upto[k + 1]] - of_body[k]).tolist():
                        yield x[ends[e] : ends[e + 1]]

        offset = np.full(len(first), -1, np.int64)
        flags = np.zeros(0, bool)
        if len(chosen):
            sorter = Sorter(sizes[chosen], texts(), length)
            flags = sorter.starts()
            offset[number[chosen]] = sorter.offset
        out = []
        for a, z in zip(of_body[:-1].tolist(), of_body[1:].tolist(), strict=True):
            windows = sizes[a:z] - length + 1
            found = np.repeat(often[number[a:z]], windows)
            to = 0
            for n, o, more in zip(windows.tolist(), offset[number[a:z]].tolist(), often[number[a:z]].tolist(), strict=True):
                if o >= 0 and not more:
                    found[to : to + n] = flags[o : o + n]
                to += n
            out.append(bits(found))
        return out

    answers = answer(ask((table, known), stretches, parts), shard, parts, "shards", shift=2 * parts)

    def apply(groups):
        for _, body, got in groups:
            t = Texts(parse(body))
            s = Stretches(t, length, gram, parts)
            starts = np.zeros(len(t.buf), bool)
            for p, strings, _, _, places in s.to_shards(t, got):
                flags = unbits(got[2 * parts + p], sum(len(x) - length + 1 for x in strings))
                at = 0
                for x, ks in zip(strings, places, strict=True):
                    m = len(x) - length + 1
                    for k in ks:
                        starts[k : k + m] = flags[at : at + m]
                    at += m
            yield run(t, cover(np.flatnonzero(starts), length, len(t.buf)))

    return meet(table, known.unionByName(answers), apply, schema)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte spans."""

    def run(t: Texts, flags: np.ndarray) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for raw, a, b in zip(t.raw, t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True):
            f = flags[a:b]
            if f.any():
                s, e = runs(f)
                kept = np.frombuffer(raw, np.uint8)[~f].tobytes()
                values = len(raw), int(f.sum()), len(s), hashlib.sha256(kept).hexdigest(), np.stack([s, e], axis=1).tolist()
            else:
                values = len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([t.batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return repeats(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>", length, hot=hot)
