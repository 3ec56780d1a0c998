"""Operator 7: benchmark decontamination by winnowing.

Words are runs of ASCII letters (lower-cased), digits and anything beyond ASCII.  On
both sides the smallest hash of every ``window - k + 1`` consecutive k-word grams is
kept, so any span of ``window`` equal words has a fingerprint in common.  Fingerprints
of the test set meet those of the documents; a hit is extended to all windows of ``window`` words
that hold it, and those that the test set has (by hash, then word by word) are hit, in runs as long
as they go on.  That takes time in proportion to the text, however often a word is repeated.  An
item of n < window words is a single window: its fingerprint is its own n-word gram
(winnowing with one gram a window).

The test set travels to the executors in blocks of at most ``BLOCK_BYTES`` of text,
whatever its size; documents are scanned once for each block and never shuffled.

Null or empty texts have no words and no hits; an item without words occurs nowhere;
repeated documents get a row each; an item with a null id counts under ''.  Repeated items count
each.  A very long text is a block of its own.  Empty tables give no rows, or no hits.  Columns
that are not kept by name are ignored; those of ``keep`` may have any name but the operator's own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import ALNUM_BYTES, LOWER, Words, cover, runs, sliding_min_at, store, text_blocks
from quillframe.shipping import ship

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 16 << 20


def lowered(buf: np.ndarray, offs: np.ndarray) -> Words:
    return Words(LOWER[buf], offs, ALNUM_BYTES)


def winnow(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the kept grams."""
    at, h = words.windows(k)
    w = window - k + 1
    if len(h) < w:
        return at[:0], h[:0]
    picked = sliding_min_at(h, w)
    whole = at[w - 1 :] - at[: len(at) - w + 1] == w - 1  # all grams of the window are of one document
    keep = np.unique(picked[whole])
    return at[keep], h[keep]


class TestSet:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, k: int):
        offs = np.concatenate(([0], np.cumsum([len(t) for _, t in items]))).astype(np.int64)
        buf = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        words = lowered(buf, offs)
        self.ids = [i for i, _ in items]
        self.window, self.k = window, k
        self.hash, self.count = words.hash, words.count
        low = words.buf
        self.text = [low[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
        self.prints = np.unique(winnow(words, window, k)[1])
        self.item = np.repeat(np.arange(len(items)), words.count)
        at, h = words.windows(window)
        order = np.argsort(h, kind="stable")
        self.spans, self.at = h[order], at[order]
        #: short items: length -> (sorted hashes, item of each)
        self.short = {}
        for n in np.unique(self.count[(self.count > 0) & (self.count < window)]):
            at, h = words.windows(int(n))
            own = np.flatnonzero(self.count[self.item[at]] == n)
            order = own[np.argsort(h[own], kind="stable")]
            self.short[int(n)] = (h[order], at[order])

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Flags of the hit words of a block of documents, and each document's items."""
        flags = np.zeros(len(words), bool)
        found: list[set[str]] = [set() for _ in words.count]
        low = words.buf

        def same(at: int, q: int, n: int) -> bool:
            return all(low[words.start[at + j] : words.end[at + j]].tobytes() == self.text[q + j] for j in range(n))

        if len(self.prints):
            at, h = winnow(words, self.window, self.k)
            met = np.zeros(len(words) + 1, np.int64)
            met[1:][at[np.isin(h, self.prints)]] = 1
            before = np.cumsum(met)
            start, span = words.windows(self.window)
            near = np.flatnonzero(before[start + self.window - self.k + 1] > before[start])  # a hit is extended to the windows that hold it
            lo = np.searchsorted(self.spans, span[near], "left")
            near, lo = near[lo < len(self.spans)], lo[lo < len(self.spans)]
            near, lo = near[self.spans[lo] == span[near]], lo[self.spans[lo] == span[near]]
            step = np.arange(self.window)
            true: dict[int, set[str]] = {}
            keep = np.zeros(len(near), bool)
            doc = np.searchsorted(words.first, start[near], "right") - 1
            for a in range(0, len(near), 1 << 16):
                own = slice(a, a + (1 << 16))
                keep[own] = (words.hash[start[near[own]][:, None] + step] == self.hash[self.at[lo[own]][:, None] + step]).all(1)
            met_once = np.unique(np.stack([lo[keep], doc[keep]]), axis=1, return_index=True)[1] if keep.any() else []
            wrong: set[int] = set()
            for x in np.flatnonzero(keep)[met_once].tolist() if len(met_once) else []:
                j = int(lo[x])
                if j not in true and j not in wrong:  # the words themselves, once for each window of the test set
                    if same(int(start[near[x]]), int(self.at[j]), self.window):
                        true[j] = {self.ids[i] for i in np.unique(self.item[self.at[j : np.searchsorted(self.spans, self.spans[j], "right")]]).tolist()}
                    else:
                        wrong.add(j)
                found[doc[x]].update(true.get(j, ()))
            keep &= ~np.isin(lo, list(wrong))
            flags |= cover(start[near[keep]], self.window, len(words))
        for n, (prints, items) in self.short.items():
            at, h = words.windows(n)
            lo = np.searchsorted(prints, h, "left")
            hi = np.searchsorted(prints, h, "right")
            met = np.flatnonzero(hi > lo)
            if len(met):
                docs = np.searchsorted(words.first, at[met], "right") - 1
                true: dict[tuple[int, int], bool] = {}
                keep = np.zeros(len(met), bool)
                for x, (d, j) in enumerate(zip(docs.tolist(), met.tolist(), strict=True)):
                    key = (d, int(lo[j]))
                    if key not in true:
                        true[key] = same(int(at[j]), int(items[lo[j]]), n)
                        if true[key]:
                            found[d].update(self.ids[self.item[q]] for q in items[lo[j] : hi[j]].tolist())
                    keep[x] = true[key]
                flags |= cover(at[met[keep]], n, len(words))
        return flags, found


def test_blocks(benchmark: DataFrame, limit: int):
    block: list[tuple[str, bytes]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    for r in rows.toLocalIterator():
        raw = r.text.encode()
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, raw))
        size += len(raw)
    yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id", "text"), clean: bool = False) -> DataFrame:
    """The columns named in ``keep``, n_words, spans (word numbers and byte places of the hit runs), items.

    clean: only the columns, without contaminated documents, the hit runs of the others cut out.
    """
    extra = ["__n_words", "__spans", "__items"] if clean else ["n_words", "spans", "items"]
    spark = docs.sparkSession
    ship(spark)
    cols = list(dict.fromkeys([*keep, "text"]))
    out = docs.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + f", {extra[0]} long, {extra[1]} array<struct<first:int,last:int,start:long,end:long>>, {extra[2]} array<string>"
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    blocks = test_blocks(benchmark, block_bytes)
    following = next(blocks)
    number = -1
    while following is not None:
        block, following, number = following, next(blocks, None), number + 1
        last = clean and following is None
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held, number=number, last=last):
            test = TestSet(held.value, window, k)
            for rows, buf, offs in text_blocks(batches):
                words = lowered(buf, offs)
                flags, found = test.hits(words)
                if number:  # hits of the blocks before
                    for d, (old, items) in enumerate(zip(rows.column(extra[1]).to_pylist(), rows.column(extra[2]).to_pylist(), strict=True)):
                        for s in old:
                            flags[words.first[d] + s["first"] : words.first[d] + s["last"]] = True
                        found[d].update(items)
                spans: dict[int, list] = defaultdict(list)
                for d in np.unique(np.searchsorted(words.first, np.flatnonzero(flags), "right") - 1).tolist():
                    f = int(words.first[d])
                    a, b = runs(flags[f : words.first[d + 1]])
                    spans[d] = [{"first": x, "last": y, "start": int(words.start[f + x] - offs[d]), "end": int(words.end[f + y - 1] - offs[d])} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                if last:
                    yield _cleaned(rows.select(cols), words.count, spans)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in cols), pa.array(words.count.astype(np.int64)), pa.array([spans.get(d, []) for d in range(rows.num_rows)], span_type), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                    names=[*cols, *extra],
                )

        if number:
            out = store(out, "winnow")
        out = out.mapInArrow(run, plain if last else schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The contract's columns: words, hit words, items met and whether a twentieth or more of the words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"]).cast("long"))
    return (
        overlaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **how)
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    )


def _cleaned(rows: pa.RecordBatch, n_words: np.ndarray, spans: dict[int, list]) -> pa.RecordBatch:
    if not spans:
        return rows
    texts = rows.column("text").to_pylist()
    stay = np.ones(rows.num_rows, bool)
    for d, own in spans.items():
        hit = sum(s["last"] - s["first"] for s in own)
        if 20 * hit >= n_words[d]:
            stay[d] = False
            continue
        raw, at, kept = texts[d].encode(), 0, []
        for s in own:
            kept.append(raw[at : s["start"]])
            at = s["end"]
        texts[d] = b"".join([*kept, raw[at:]]).decode()
    cut = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else rows.column(c) for c in rows.schema.names], names=rows.schema.names)
    return cut.filter(pa.array(stay))
