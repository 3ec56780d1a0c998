"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of documents, the last one token ids:

1. quality: documents that the pairwise ranking puts below its cut go;
2. near duplicates: of each group of linked documents the one with the smallest doc_id stays
   (rows that share a doc_id are one document; documents without an id stay);
3. repeated passages: runs of 20 words or more lose all but their first occurrence;
4. benchmark: contaminated documents go, and what the others hold of it is cut out;
5. encoding: ids of the byte-level BPE and digests of the round trip.

Null texts are empty documents and stay unless a stage's own rule drops them; n_chars follows
the text.  Columns beyond those of documents pass through, whatever their names.  Repeated rows are
rows each until stage 2.  An empty table gives no rows at any stage; without labels nothing is
dropped for quality, without a benchmark nothing for contamination.  A very long text is worked on whole, in one task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.llm import pairwise_quality
from quillframe.llm.block_anchors import without_repeats
from quillframe.llm.common import drop_stored, load, store
from quillframe.llm.prefix_join import near_duplicates
from quillframe.llm.rank_bpe import encode_decode
from quillframe.llm.winnow import overlaps


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pairwise_quality.fit(docs, load(spark, sf_dir, "labels"))
    return pairwise_quality.score(docs, model, keep=tuple(docs.columns), prefix="__quality_").where("__quality_predicted = 1").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = near_duplicates(docs).select(F.col("component_id").alias("stays")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.stays), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(without_repeats(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(overlaps(docs, load(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), clean=True).select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
