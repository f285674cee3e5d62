"""Fact tables from the relational inputs, so that the structural operators can run on, and be checked over, plain tables.

A document is a file. A line's first word is a definition if it has at least `MIN_NAME` letters; every other word is an
occurrence. A definition spans its line up to the line before the file's next definition. A file imports the file of its
source that comes just before it by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_NAME = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(doc_id: str = "doc_id") -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col(doc_id).cast("string"), 9, "0"), F.lit(".txt")))


def files(docs: DataFrame) -> DataFrame:
    """path, doc_id, source, lang, text."""
    return docs.select(path_of().alias("path"), "doc_id", "source", "lang", "text")


def words(docs: DataFrame) -> DataFrame:
    """path, line, pos, name: the words of each line, lower case."""
    lines = files(docs).select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line_text"))
    each = F.regexp_extract_all(F.lower("line_text"), F.lit("[a-z]+"), F.lit(0))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.posexplode(each).alias("pos", "name"))


def is_definition() -> Column:
    return (F.col("pos") == 0) & (F.length("name") >= MIN_NAME)


def symbols(docs: DataFrame) -> DataFrame:
    """path, name, line, end_line (null for the last), ordinal (of a repeated name in a file)."""
    by_line = W.partitionBy("path").orderBy("line")
    defs = words(docs).where(is_definition()).select("path", "name", "line")
    defs = defs.withColumn("end_line", F.lead("line").over(by_line) - 1)
    return defs.withColumn("ordinal", F.row_number().over(W.partitionBy("path", "name").orderBy("line")) - 1)


def references(docs: DataFrame) -> DataFrame:
    """path, name, line: one row for each occurrence that is no definition."""
    return words(docs).where(~is_definition()).select("path", "name", "line")


def imports(docs: DataFrame) -> DataFrame:
    """src, dst: each file imports the one before it in its source."""
    before = F.lag("path").over(W.partitionBy("source").orderBy("doc_id"))
    return files(docs).select("path", "source", "doc_id").select(F.col("path").alias("src"), before.alias("dst")).where("dst is not null")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: customers' nation to suppliers' nation by revenue in millions, rounded to 6 places."""
    item, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    customer, supplier, nation = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e6
    rows = item.select("l_orderkey", "l_suppkey", revenue.alias("r")).join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum("r"), 6).alias("weight"))
    a, b = (nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n)) for k, n in (("c_nationkey", "src"), ("s_nationkey", "dst")))
    return sums.join(a, "c_nationkey").join(b, "s_nationkey").where("src <> dst").select("src", "dst", "weight")


def event_candidates(events: DataFrame) -> DataFrame:
    """run, id, index, key, applied, measured, regression_passed, reproduction_passed: a user's events as candidate changes."""
    at = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("run"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), (F.row_number().over(at) - 1).alias("index"), F.col("event_type").alias("key"),
        (F.col("event_id") % 11 != 0).alias("applied"), (F.col("event_id") % 7 != 0).alias("measured"), (F.col("value") >= 40).alias("regression_passed"), (F.col("value") >= 80).alias("reproduction_passed"),
    )
