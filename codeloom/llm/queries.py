"""The registered queries of this package: thin digests of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import oracles
from codeloom.llm.bpe import encode
from codeloom.llm.common import table
from codeloom.llm.embedding_dedup import near_vectors
from codeloom.llm.language import language, learn
from codeloom.llm.licenses import scan
from codeloom.llm.media import media_digests
from codeloom.llm.mixing import label_domains, mix
from codeloom.llm.near_dedup import near_duplicates
from codeloom.llm.quality import quality
from codeloom.llm.substring_dedup import substring_dedup
from codeloom.llm.token_counts import token_counts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the tokens clean, a quarter each low and toxic, as a classifier's training set would want them."""
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), {"clean": 0.5, "low": 0.25, "toxic": 0.25})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k.lower(): sql for k, sql in vars(oracles).items() if k.startswith("OP")}
