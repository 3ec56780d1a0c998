"""Operator 10: canonical exact digest.

A text's canonical form: NFKC, case folding, NFKC again, white space runs to one space,
trimmed.  Its fingerprint is the 128-bit xxhash of that in hexadecimal; documents are
grouped by it, and inside buckets of two or more the canonical bytes are compared: a
second, third ... class of different bytes under one digest gets the suffix -1, -2 ...
The likeness of two exact fingerprints is 1 where the canonical bytes are equal, else 0.

Null texts are empty.  Rows are in order of (doc_id, text), null ids first, and the row
after the last is the first; repeated rows are rows of their own.  An empty table gives no rows, one
row is its own next; a very long text is a row of one task.  Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import store, tasks_for

NO_ID = -(1 << 63)
SALTS = 16


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (before any comparison of bytes)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(canonical(t)) for t in b.column(1).to_pylist()])], names=["doc_id", "digest"])

    return _keyed(docs).mapInArrow(run, "doc_id long, digest string")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns.  The texts are shuffled once, in ranges of doc_id.

    The first document of each range goes also, as its last row, to the range before;
    markers of documents that share a digest go along with the texts, so that only
    those bring their canonical bytes to the comparison.
    """
    spark = docs.sparkSession
    parts = tasks_for(docs)
    keyed = _keyed(docs)
    shares = ", ".join(f"{k / parts:.9f}D" for k in range(parts))
    got = keyed.selectExpr(f"percentile_approx(doc_id, array({shares}), {max(10000, 20 * parts)}) as q", "min(doc_id) as low").first()
    heads = np.unique(np.array([*(got.q or []), *([got.low] if got.low is not None else [])], np.int64))
    n = max(1, len(heads))

    def place(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            at = np.searchsorted(heads, ids, "right") - 1
            rows = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(ids), bool)), *b.columns], names=["part", "ghost", "doc_id", "marker", "text"])
            yield rows
            first = (heads[at] == ids) & ~b.column("marker").to_numpy(zero_copy_only=False)
            if first.any():
                more = rows.filter(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array(((at[first] - 1) % n).astype(np.int32)), pa.array(np.ones(more.num_rows, bool)), *more.columns[2:]], names=rows.schema.names)

    shared = digests(docs)
    known = store(shared, "digests")
    twice = known.groupBy("digest").count().where("count > 1").select("digest")
    # salted: a digest may belong to a third of all rows
    salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    markers = known.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).select("doc_id", F.lit(True).alias("marker"), F.lit(None).cast("string").alias("text"))

    def edit(batches):
        press = zstandard.ZstdCompressor()
        marked = None  # the last marker's document; its texts come next
        last = None

        def row(here, after):
            doc_id, text, twin = here
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own, new, nxt = canonical(text), canonical(edited), canonical(after)
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(new), float(own == new), float(own == nxt), press.compress(own) if twin else None

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "digest", "edited_fingerprint", "near_edited", "near_next", "form"])

        over = False
        for b in batches:
            rows = []
            if over:
                continue
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                for ghost, doc_id, marker, text in zip(s.column("ghost").to_pylist(), s.column("doc_id").to_pylist(), s.column("marker").to_pylist(), s.column("text").to_pylist(), strict=True):
                    if marker:
                        marked = doc_id
                        continue
                    if last is not None and not over:
                        rows.append(row(last, text))
                    over = ghost
                    last = None if ghost else (doc_id, text, doc_id == marked)
                    if ghost:
                        break
                if over:
                    break
            if rows:
                yield batch_of(rows)

    everything = keyed.select("doc_id", F.lit(False).alias("marker"), "text").unionByName(markers)
    schema = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_fingerprint string, near_edited double, near_next double, form binary"
    made = (
        everything.mapInArrow(place, "part int, ghost boolean, doc_id long, marker boolean, text string")
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "ghost", "doc_id", F.desc("marker"), "text")
        .mapInArrow(edit, schema)
    )
    made = store(made, "fingerprints")
    classes = made.where("form is not null").groupBy("digest", "form").agg(F.min("doc_id").alias("first"))
    clashes = classes.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("first", "form"))).alias("classes")).where("size(classes) > 1").selectExpr("digest", "posexplode(classes) as (rank, class)").where("rank > 0").selectExpr("digest", "class.form as form", "rank")
    clashes = store(clashes, "clashes")
    made = made.withColumn("rank", F.lit(None).cast("int")) if clashes.isEmpty() else made.join(clashes, ["digest", "form"], "left")
    return made.select(
        F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.concat("digest", F.coalesce(F.concat(F.lit("-"), F.col("rank").cast("string")), F.lit(""))).alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
