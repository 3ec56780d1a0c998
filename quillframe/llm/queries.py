"""The queries op1 to op10: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import oracles, pairwise_quality, suffix_tree_lm
from quillframe.llm.block_anchors import passage_digests
from quillframe.llm.common import load
from quillframe.llm.exact_digest import fingerprints
from quillframe.llm.prefix_join import near_duplicates
from quillframe.llm.rank_bpe import encode_decode
from quillframe.llm.site_style import extract
from quillframe.llm.suffix_dedup import repeated_bytes
from quillframe.llm.token_files import token_files
from quillframe.llm.winnow import decontaminate


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("width")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(load(spark, sf_dir, "documents")).drop("spans")


def op3_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(load(spark, sf_dir, "documents"))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pairwise_quality.score(docs, pairwise_quality.fit(docs, load(spark, sf_dir, "labels")))


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(load(spark, sf_dir, "documents")).drop("spans")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op10_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_suffix_dedup, op3_site_style, op4_suffix_tree_lm, op5_pairwise_quality, op6_block_anchors, op7_winnowing, op8_rank_bpe, op9_prefix_join, op10_exact_digest)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
