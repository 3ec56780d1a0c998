"""Suffix sorting by induction, with common-prefix values, over disk-backed queues.

``repeat_starts`` tells of every position of a set of strings whether the ``length`` bytes
there start elsewhere in the set too.  It sorts the suffixes of the strings, one behind
the other, by induction:

1. suffixes are S (smaller than the next) or L; an S behind an L is leftmost (LMS);
2. LMS substrings are sorted by inducing from their first bytes, and named;
3. LMS suffixes are ranked by their names;
4. two priority queues, keyed by (first byte, arrival), carry tuples (position, common
   prefix with the tuple before) from the sorted LMS suffixes to all L suffixes in
   ascending order, and from those to all S suffixes in descending order.

A suffix passed on gets one more than the smallest common prefix scanned since the last
tuple of the same bucket, so common prefixes come out of the induction, cut at ``length``.
A queue is popped and pushed up to ``AT_ONCE`` tuples of a bucket at a time; tuples that stay
in the bucket queue up behind, which keeps the order of arrival.

Step 3 recurses by rank doubling over the reduced string, not by another induction: its
alphabet is as large as the string, so an induction would go on tuple by tuple; and as
prefixes beyond ``length`` bytes decide nothing, a bounded number of rounds is enough.

Text, types, queues, ranks, orders and flags are arrays that live in files of the executor's scratch folders
(``SPARK_LOCAL_DIRS``, as Spark's own spills) once a shard has ``IN_MEMORY`` bytes or more;
the files are unlinked when made, so nothing is left behind whatever happens.  Such an array
is read and written ``AT_ONCE`` entries at a time and sorted in place; in memory stay only the
sizes and offsets of the strings.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np

from quillframe.llm.common import U64, mix, prefix_sums, span_hash

IN_MEMORY = 12 << 20
AT_ONCE = 1 << 19  # tuples popped at once


class Room:
    """Arrays in memory, or in unlinked scratch files for large shards."""

    def __init__(self, size: int, limit: int = IN_MEMORY):
        self.disk = size >= limit

    def __call__(self, n: int, kind) -> np.ndarray:
        if not self.disk or not n:
            return np.zeros(n, kind)
        folder = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        with tempfile.TemporaryFile(dir=folder) as f:
            return np.memmap(f, kind, "w+", shape=(n,))


def spans(n: int):
    for a in range(0, n, AT_ONCE):
        yield a, min(n, a + AT_ONCE)


class BucketQueue:
    """A priority queue of (position, common prefix) keyed by (symbol, arrival)."""

    def __init__(self, counts: np.ndarray, room: Room, carry: bool):
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.tail = self.start[:-1].copy()
        self.place = room(int(self.start[-1]), np.int64 if self.start[-1] >= 1 << 31 else np.int32)
        self.shared = room(int(self.start[-1]), np.uint16) if carry else None
        self.low = np.zeros(len(counts), np.int64)  # smallest common prefix scanned since a bucket's last tuple

    def push(self, symbols: np.ndarray, places: np.ndarray, at: np.ndarray, scanned: np.ndarray | None, cap: int) -> None:
        """symbols, places: tuples in scan order, ``at`` their places in the scan; scanned: its common prefixes."""
        if not len(symbols):
            if scanned is not None and len(scanned):
                np.minimum(self.low, scanned.min(), out=self.low)
            return
        order = np.argsort(symbols.astype(np.uint16), kind="stable")
        s = symbols[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(first, len(s)))
        names = s[first].astype(np.int64)
        to = np.repeat(self.tail[names] - first, size) + np.arange(len(s))
        self.place[to] = places[order]
        if scanned is not None:
            j = at[order]
            begin = np.empty(len(j), np.int64)
            begin[1:] = j[:-1] + 1
            begin[first] = 0
            padded = np.append(scanned, np.iinfo(scanned.dtype).max)
            got = np.minimum.reduceat(padded, np.stack([begin, j + 1], axis=1).ravel())[::2].astype(np.int64)
            got[first] = np.minimum(got[first], self.low[names])
            self.shared[to] = np.minimum(got + 1, cap)
            self.shared[to[first][self.tail[names] == self.start[names]]] = 0
            last = j[first + size - 1]
            rest = np.minimum.accumulate(scanned[::-1])[::-1]
            np.minimum(self.low, rest[0], out=self.low)
            self.low[names] = np.append(rest, cap)[last + 1]
        self.tail[names] += size

    def taken(self, symbol: int, done: int) -> slice:
        """The next tuples of a bucket after the first ``done``, a bounded number."""
        start = int(self.start[symbol]) + done
        return slice(start, min(int(self.tail[symbol]), start + AT_ONCE))


class Sorter:
    def __init__(self, sizes: np.ndarray, strings: Iterable[bytes], length: int, in_memory: int = IN_MEMORY):
        total = int(sizes.sum()) + len(sizes) + 1
        room = self.room = Room(total, in_memory)
        self.cap, self.n = length, total
        text = self.text = room(total, np.uint16)  # bytes + 2; 1 ends a string, 0 the text
        self.offset = np.cumsum(sizes + 1) - sizes - 1
        at, some, held = 0, [], 0

        def write() -> None:
            nonlocal at, some, held
            part = np.frombuffer(b"\0".join([*some, b""]), np.uint8)
            text[at : at + len(part)] = part
            text[at : at + len(part)] += 2
            at, some, held = at + len(part), [], 0

        for x in strings:
            some.append(x)
            held += len(x)
            if held >= AT_ONCE:
                write()
        write()
        text[self.offset + sizes] = 1
        text[total - 1] = 0
        self.alphabet = 258
        self._types()
        self.sums = room(total + 1, U64)
        codes = mix(np.arange(1, self.alphabet + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        prefix_sums(text, codes, self.sums)

    def _types(self) -> None:
        t = self.text
        small = self.small = self.room(self.n, bool)  # S
        self.of_small, of_all = np.zeros(self.alphabet, np.int64), np.zeros(self.alphabet, np.int64)
        for a, z in reversed(list(spans(self.n))):
            x = np.array(t[a : z + 1])
            differs = np.flatnonzero(x[1:] != x[:-1])
            upto = np.diff(np.concatenate(([0], differs + 1, [z - a])))
            own = np.repeat(np.append(x[differs] < x[differs + 1], small[z] if z < self.n else True), upto)
            small[a:z] = own
            self.of_small += np.bincount(x[: z - a][own], minlength=self.alphabet)
            of_all += np.bincount(x[: z - a], minlength=self.alphabet)
        self.of_large = of_all - self.of_small

        def leftmost(a: int, z: int) -> np.ndarray:
            return a + np.flatnonzero(small[a:z] & ~np.concatenate(([small[a - 1] if a else True], small[a : z - 1])))

        self.lms = self.room(sum(len(leftmost(a, z)) for a, z in spans(self.n)), np.int64)
        at = 0
        for a, z in spans(self.n):
            x = leftmost(a, z)
            self.lms[at : at + len(x)] = x
            at += len(x)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, cut at the cap: halving over hashes of spans."""
        got = np.zeros(len(a), np.int64)
        step = 1 << (self.cap - 1).bit_length()
        room = np.minimum(self.n - np.maximum(a, b), self.cap)
        while step:
            want = got + step
            fits = np.flatnonzero(want <= room)
            u, v, w = a[fits], b[fits], want[fits]
            same = span_hash(self.sums, u, u + w) == span_hash(self.sums, v, v + w)
            got[fits[same]] = w[same]
            step >>= 1
        return got

    def _one(self, a: int, b: int) -> int:
        return int(self.prefix(np.array([a]), np.array([b]))[0])

    def induce(self, lms: np.ndarray, shared: np.ndarray | None, visit=None):
        """From LMS suffixes in order (and their common prefixes) all suffixes.

        visit(places, common prefixes) is told of all suffixes in descending order; without
        common prefixes the LMS suffixes come back in the order of the induction.
        """
        t, carry = self.text, shared is not None
        large = BucketQueue(self.of_large, self.room, carry)
        edges = np.zeros(self.alphabet + 1, np.int64)
        for a, z in spans(len(lms)):
            edges[1:] += np.bincount(t[lms[a:z]], minlength=self.alphabet)
        edges = np.cumsum(edges)
        for c in range(self.alphabet):
            done, last = 0, -1
            while True:
                own = large.taken(c, done)
                if own.stop == own.start:
                    break
                x = np.array(large.place[own], np.int64)
                done += len(x)
                last = int(x[-1])
                self._pass(large, x, large.shared[own].astype(np.int64) if carry else None, lambda s, c=c: s >= c)
            for lo in range(int(edges[c]), int(edges[c + 1]), AT_ONCE):
                x = np.array(lms[lo : min(lo + AT_ONCE, int(edges[c + 1]))])
                scan = None
                if carry:
                    scan = shared[lo : lo + len(x)].astype(np.int64)
                    if lo == edges[c]:
                        scan[0] = self._one(last, int(x[0])) if last >= 0 else 0
                self._pass(large, x, scan, lambda s, c=c: s > c)
        small = BucketQueue(self.of_small, self.room, carry)
        ordered, left = (None, 0) if carry else (self.room(len(lms), np.int64), len(lms))
        for c in range(self.alphabet - 1, -1, -1):
            done, last = 0, -1
            if c == 0:  # the end of the text: no suffix is smaller
                if not carry:
                    ordered[0] = self.n - 1
                break
            while True:
                own = small.taken(c, done)
                if own.stop == own.start:
                    break
                x = np.array(small.place[own], np.int64)
                done += len(x)
                scan = small.shared[own].astype(np.int64) if carry else None
                last = int(x[-1])
                self._pass(small, x, scan, lambda s, c=c: s <= c)
                if visit is not None:
                    visit(x, scan)
                if not carry:
                    x = x[np.where(x > 0, ~self.small[x - 1], False)]
                    ordered[left - len(x) : left] = x[::-1]
                    left -= len(x)
            low, high = int(large.start[c]), int(large.tail[c])
            for top in range(high, low, -AT_ONCE):
                own = slice(max(low, top - AT_ONCE), top)
                x = np.array(large.place[own], np.int64)[::-1]
                scan = None
                if carry:
                    seam = int(large.shared[top]) if top < high else self._one(last, int(x[0])) if last >= 0 else 0
                    scan = np.concatenate(([seam], large.shared[own].astype(np.int64)[:0:-1]))
                self._pass(small, x, scan, lambda s, c=c: s < c)
                if visit is not None:
                    visit(x, scan)
        return ordered

    def _pass(self, queue: BucketQueue, x: np.ndarray, scan: np.ndarray | None, wanted) -> None:
        before = x - 1
        s = np.where(x > 0, self.text[before], 0).astype(np.int64)
        take = np.flatnonzero((x > 0) & wanted(s))
        queue.push(s[take], before[take], take, scan, self.cap)

    def sorted_lms(self) -> np.ndarray:
        """LMS suffixes ordered by their first ``cap`` bytes at least."""
        lms, m, room, low = self.lms, len(self.lms), self.room, U64(0xFFFFFFFF)
        key, by, rank, named = room(m, U64), room(m, np.int64), room(m, np.int64), room(m, np.int64)

        def sort(values) -> None:
            """key: the places of values(from, to) in stable order, in the low halves."""
            for a, z in spans(m):
                key[a:z] = (values(a, z).astype(U64) << U64(32)) | np.arange(a, z, dtype=U64)
            key.sort()

        def places(a: int, z: int) -> np.ndarray:
            return (key[a:z] & low).astype(np.int64)

        sort(lambda a, z: self.text[lms[a:z]])
        for a, z in spans(m):
            by[a:z] = lms[places(a, z)]
        order = self.induce(by, None)
        last, names = None, 0
        for a, z in spans(m):
            x = np.array(order[a:z])
            k = np.searchsorted(lms, x)
            end = np.where(k + 1 < m, lms[np.minimum(k + 1, m - 1)] + 1, self.n)
            p, q = (np.concatenate(([own[0] if last is None else was], own[:-1])) for own, was in zip((x, end), last or (0, 0), strict=True))
            new = (q - p != end - x) | (span_hash(self.sums, p, q) != span_hash(self.sums, x, end))
            new[0] |= last is None
            rank[k] = names + np.cumsum(new)
            names, last = names + int(new.sum()), (x[-1], end[-1])
        step = 1
        while step <= self.cap and names < m:

            def after(k, step=step):
                return np.where(k + step < m, rank[np.minimum(k + step, m - 1)], 0)

            sort(lambda a, z: after(np.arange(a, z)))
            for a, z in spans(m):
                by[a:z] = places(a, z)
            sort(lambda a, z: rank[by[a:z]])
            last, names = None, 0
            for a, z in spans(m):
                k = by[places(a, z)]
                one, two = rank[k], after(k)
                new = np.ones(len(k), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                new[0] = last != (one[0], two[0])
                named[k] = names + np.cumsum(new)
                names, last = names + int(new.sum()), (one[-1], two[-1])
            rank, named = named, rank
            step *= 2
        sort(lambda a, z: rank[a:z])
        for a, z in spans(m):
            by[a:z] = lms[places(a, z)]
        return by

    def starts(self) -> np.ndarray:
        """Flags of the places whose first ``cap`` symbols start elsewhere too."""
        flags = self.room(self.n, bool)
        order = self.sorted_lms()
        shared = self.room(len(order), np.uint16)
        for a, z in spans(len(order) - 1):
            shared[a + 1 : z + 1] = self.prefix(order[a:z], order[a + 1 : z + 1])

        before = [0]

        def visit(places, common):
            pair = np.flatnonzero(common >= self.cap)
            flags[places[pair]] = True
            flags[np.where(pair > 0, places[pair - 1], before[0])] = True
            before[0] = int(places[-1])

        self.induce(order, shared, visit)
        return flags


def repeat_starts(strings: list[bytes], length: int, in_memory: int = IN_MEMORY) -> list[np.ndarray]:
    """For each string: of each of its windows of ``length`` bytes, whether it starts elsewhere in the strings too."""
    if not strings:
        return []
    sorter = Sorter(np.array([len(s) for s in strings], np.int64), strings, length, in_memory)
    flags = sorter.starts()
    return [flags[o : o + max(0, len(s) - length + 1)] for o, s in zip(sorter.offset.tolist(), strings, strict=True)]
