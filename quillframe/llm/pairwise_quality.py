"""Operator 5: document quality by Bradley-Terry pairwise ranking.

Every labelled good document is preferred to every labelled bad one.  Scores are linear
in features of the text alone; their weights come from logistic loss on the feature
differences of preference pairs (P(a beats b) = sigmoid(score a - score b)).  The cut is
the quantile of the scores of all labelled documents of the training folds that equals the
share of bad ones among them (ranks are exact up to ``RANKS`` rows, beyond that to one in
``RANKS``); scores are shifted so that it lies at ``THRESHOLD`` and squashed to 0..1.

Fitting the weights uses at most ``SAMPLE`` labelled documents (the smallest hashes of doc_id, so the
same ones on any cluster) and ``PAIRS`` pairs; every document is scored, in one pass
without a shuffle, and before that the labelled ones for the cut: up to ``SENT`` labels are
broadcast to the texts; of more, all texts of the training folds are scored and only ids and
scores meet the labels.  Null texts are empty and scored like them.  Without labels of both
kinds every score is 0.5.  Repeated rows are scored alike; repeated labels count again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import U64, WORD_BYTES, Words, byte_table, drop_stored, store, text_blocks
from quillframe.shipping import ship

SAMPLE, PAIRS, THRESHOLD, RANKS = 6000, 200_000, 0.3, 100_000
SENT = 1_000_000  # labels, of an id and a flag each
LINE_BYTES = byte_table((0x0A, 0x0A))

FEATURES = [
    "log words", "upper letters", "digits", "symbols", "full stops and commas", "marks ! ?", "bars and markup", "white space", "beyond ASCII",
    "word length", "long words", "words that repeat the one before", "distinct words", "most frequent word", "words without letters",
    "words with an inner or final symbol", "words all upper", "repeated lines", "words a line", "distinct triples",
]


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[0x41:0x5B] = 1
    kind[0x61:0x7B] = 2
    kind[0x30:0x3A] = 3
    for b in b"#$%&*@^~+=_\\":
        kind[b] = 4
    for b in b".,;:":
        kind[b] = 5
    for b in b"!?":
        kind[b] = 6
    for b in b"|<>{}[]/":
        kind[b] = 7
    for b in b" \t\n\r\v\f":
        kind[b] = 8
    kind[0x80:] = 9
    return kind


KIND = _kinds()


def _distinct(doc: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of distinct codes and the count of the most frequent."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    key = code ^ (doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], size)
    return np.bincount(d[at], minlength=n).astype(float), most


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(offs) - 1
    kind = KIND[buf]
    by = [_sums(kind == k, offs) for k in range(1, 10)]
    size = np.maximum(1, np.diff(offs))
    w = Words(buf, offs, WORD_BYTES)
    words, doc = np.maximum(1, w.count), w.doc()
    length = (w.end - w.start).astype(float)
    per = lambda flags: np.bincount(doc, weights=flags.astype(float), minlength=n) / words
    again = np.zeros(len(w), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    has = lambda wanted: (lambda t: t[w.end] > t[w.start])(np.concatenate(([0], np.cumsum(wanted, dtype=np.int64))))
    letter, lower = has((kind == 1) | (kind == 2) | (kind == 9)), has((kind == 2) | (kind == 9))
    odd = has((kind == 4) | (kind == 6) | (kind == 7))
    distinct, most = _distinct(doc, w.hash, n)
    at, triple = w.windows(3)
    three, _ = _distinct(doc[at], triple, n)
    triples = np.maximum(1, np.bincount(doc[at], minlength=n))
    lines = Words(buf, offs, LINE_BYTES)
    n_lines = np.maximum(1, lines.count)
    kept, _ = _distinct(lines.doc(), lines.hash, n)
    letters = np.maximum(1, by[0] + by[1] + by[8])
    cols = [
        np.log1p(w.count), by[0] / letters, by[2] / size, by[3] / size, by[4] / words, by[5] / words, by[6] / words, by[7] / size, by[8] / size,
        np.bincount(doc, weights=length, minlength=n) / words, per(length > 20), per(again), distinct / np.sqrt(words), most / words, per(~letter),
        per(odd), per(letter & ~lower), 1 - np.minimum(1, kept / n_lines), np.log1p(words / n_lines), np.where(w.count < 3, 1.0, three / triples),
    ]
    return np.stack(cols, axis=1)


class Ranking:
    """Standardised features, weights, and the shift that puts the cut at THRESHOLD."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = 60, ridge: float = 1e-3, threshold: float = THRESHOLD, seed: int = 5):
        self.middle, self.scale = np.zeros(2 * x.shape[1]), np.ones(2 * x.shape[1])
        self.weight, self.cut, self.threshold = np.zeros(2 * x.shape[1]), 0.0, threshold
        self.centre, self.spread = (np.median(x, 0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.fitted = bool(good.any() and not good.all())
        if not self.fitted:
            return
        z = self._expand(x)
        self.middle, self.scale = z.mean(0), z.std(0) + 1e-6
        z = (z - self.middle) / self.scale
        dice = np.random.default_rng(seed)
        a, b = np.flatnonzero(good), np.flatnonzero(~good)
        diff = z[dice.choice(a, pairs)] - z[dice.choice(b, pairs)]
        w = self.weight
        for _ in range(rounds):  # Newton steps of the Bradley-Terry loss
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            grad = diff.T @ (p - 1) / pairs + ridge * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + (ridge + 1e-6) * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.weight = w
        s = z @ w
        share = (~good).mean()
        self.cut = float((np.quantile(s, share, method="lower") + np.quantile(s, share, method="higher")) / 2)

    def _expand(self, x: np.ndarray) -> np.ndarray:
        """Each feature and its distance from the usual value, both bounded."""
        z = np.clip((x - self.centre) / self.spread, -4, 4)
        return np.concatenate([z, np.abs(z)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self._expand(x) - self.middle) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        s = self.raw(x) - self.cut
        return 1 / (1 + np.exp(-np.clip(s + np.log(self.threshold / (1 - self.threshold)), -30, 30)))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sent: int = SENT) -> Ranking:
    """Fit on at most ``sample`` labelled rows of the training folds, cut by all of them."""
    labelled = labels.where("quality is not null and doc_id is not null").where(fold() != 0).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(sample)

    def run(batches):
        for rows, buf, offs in text_blocks(batches):
            x = features(buf, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("good"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, good boolean, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.good, r.x))
    model = Ranking(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.good for r in rows], bool))
    if model.fitted:
        model.cut = _cut(docs, labelled, model, sent)
    return model


def _cut(docs: DataFrame, labelled: DataFrame, model: Ranking, sent: int) -> float:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, buf, offs in text_blocks(batches):
            others = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(rows.column, others), pa.array(held.value.raw(features(buf, offs)))], names=[*others, "raw"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").where(fold() != 0)
    ids = labelled.groupBy("doc_id").agg(F.count_if("good").alias("good"), F.count("*").alias("n"))
    if labelled.count() <= sent:
        rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "good", "n").mapInArrow(run, "doc_id long, good long, n long, raw double")
    else:
        rows = texts.mapInArrow(run, "doc_id long, raw double").join(ids, "doc_id")
    scores = store(rows.select("raw", F.explode(F.expr("transform(sequence(1, n), i -> i <= good)")).alias("good")), "quality-scores")
    n, bad = scores.agg(F.count("*"), F.count_if(~F.col("good"))).first()
    at = bad / n * (n - 1)
    ranks = [(math.floor(at) + 0.5) / n, (math.ceil(at) + 0.5) / n]
    low, high = scores.agg(F.percentile_approx("raw", ranks, RANKS)).first()[0]
    drop_stored(scores)
    return (low + high) / 2


def score(docs: DataFrame, model: Ranking, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted and the columns named in ``keep``; prefix: of the new columns, where theirs are taken."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + "held_out", prefix + "score", prefix + "predicted"]

    def run(batches):
        for rows, buf, offs in text_blocks(batches):
            s = held.value.score(features(buf, offs))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s), pa.array((s >= held.value.threshold).astype(np.int32))], names=[*rows.schema.names, *names[1:]])

    cols = list(dict.fromkeys(["doc_id", "text", *keep]))
    part = docs.select(*cols)
    scored = part.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema) + f", {names[1]} double, {names[2]} int")
    return scored.withColumn(names[0], fold() == 0).select(*(c for c in cols if c != "text" or "text" in keep), *names)
