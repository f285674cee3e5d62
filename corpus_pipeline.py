"""The corpus pipeline: each stage works on all that the one before it kept, through one operator of the llm package.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet and read again. A row is told by its doc_id and its text, which operators carry
along: several texts under one doc_id are judged each for itself. Defined results: rows without doc_id leave in the first
stage, rows that repeat (doc_id and text) are one from near-dedup on; null texts count as empty; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.bpe import encode
from codeloom.llm.common import cut, fresh, row_key, table
from codeloom.llm.mixing import copies, label_domains, mix
from codeloom.llm.near_dedup import near_duplicates
from codeloom.llm.quality import quality
from codeloom.llm.substring_dedup import substring_dedup


#: Shares of tokens that mixing aims at; those of low and toxic documents are never above what there is.
TARGETS = {"clean": 0.95, "low": 0.02, "toxic": 0.03}


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key of the text, and that column's name."""
    key = fresh(docs, "_text_key")
    return docs.withColumn(key, row_key(F.col("text"))), key


def _kept(docs: DataFrame, keyed: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of `keyed` that `kept` (doc_id, key) names, with docs' own columns."""
    return keyed.join(kept.select("doc_id", key).distinct(), ["doc_id", key], "left_semi").select(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    keyed, key = _keyed(docs)
    return _kept(docs, keyed, quality(keyed, table(spark, sf_dir, "labels"), carry=(key,)).where("predicted = 1"), key)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the least doc_id, and of its texts in the group the one of least key."""
    keyed, key = _keyed(docs)
    found = near_duplicates(keyed, carry=(key,)).where("kept")
    one = found.groupBy("doc_id").agg(F.min(key).alias(key))
    rows = keyed.dropDuplicates(["doc_id", key])
    return _kept(docs, rows, one, key)


def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents that held nothing else go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = substring_dedup(docs, texts=True, carry=others).where("n_removed = 0 or n_removed < n_words")
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def reweigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say: domains that are short of their target repeat, others thin out."""
    keyed, key = _keyed(docs)
    times, place = fresh(keyed, "_copies"), fresh(keyed, "_copy")
    rates = mix(keyed, label_domains(table(spark, sf_dir, "labels")), TARGETS, kept="clean", carry=(key,))
    rates = rates.select("doc_id", key, copies(F.col("rate"), F.col("doc_id")).alias(times)).groupBy("doc_id", key).agg(F.max(times).alias(times))
    taken = keyed.join(rates.where(F.col(times) > 0), ["doc_id", key])
    return taken.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality classifier", classify), ("near-dedup", deduplicate), ("substring dedup", strip_passages), ("mixing", reweigh), ("BPE encoding", tokenise)]

#: Trained stages can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, like="stage")
    return docs
