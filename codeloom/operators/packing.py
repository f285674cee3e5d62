"""Budgets, listings and intervals: greedy packing, fair shares, merging, trees, carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


def auto_budget(full: Column, share: int = 6, least: int = 2000, most: int = 8000) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(full / share)))


def pack(rows: DataFrame, partition: list[str], order: list[Column], cost: str, budget: Column) -> DataFrame:
    """rows with `place`, `used` (running cost) and `included`: the longest prefix whose cost fits the budget."""
    w = W.partitionBy(*partition).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("used", running).withColumn("included", F.col("used") <= budget)


def fair_shares(rows: DataFrame, partition: list[str], key: str, cost: str, budget: int) -> DataFrame:
    """rows with `granted`: water filling. Whoever needs no more than an even share of what is left gets all it needs;
    the others share the rest evenly (rounded down).

    In order of need, the k-th of n is satisfied if everyone so far is and its need is at most the even share of what the
    smaller ones leave; so one sorted window replaces the rounds.
    """
    w = W.partitionBy(*partition).orderBy(cost, key)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.count(F.lit(1)).over(W.partitionBy(*partition)) - F.row_number().over(w) + 1
    rows = rows.withColumn("_share", F.floor((F.lit(budget) - before) / left)).withColumn("_fits", F.col(cost) <= F.col("_share"))
    all_before = F.min(F.col("_fits").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_full", all_before == 1)
    first = F.min_by("_share", F.when(~F.col("_full"), F.struct(F.col(cost), F.col(key)))).over(W.partitionBy(*partition))
    return rows.withColumn("granted", F.when(F.col("_full"), F.col(cost)).otherwise(F.greatest(first, F.lit(0)))).drop("_share", "_fits", "_full")


def merge_intervals(rows: DataFrame, partition: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """partition columns, start, end: overlapping or touching (equal ends) intervals as one; neighbours stay apart."""
    w = W.partitionBy(*partition).orderBy(start, end)
    high = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.where(F.col(start) <= F.col(end)).withColumn("_new", F.when(high.isNull() | (F.col(start) > high), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*partition, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def folders(paths: DataFrame) -> DataFrame:
    """folder, depth, files: how many files each folder holds at any depth."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    some = paths.where(F.size(parts) > 1).select(F.explode(each).alias("p"))
    return some.groupBy(F.col("p.folder").alias("folder"), F.col("p.depth").alias("depth")).agg(F.count(F.lit(1)).alias("files"))


def tree(paths: DataFrame, depth: int = 3, max_entries: int = 200) -> DataFrame:
    """place, line: nested names in pre-order, four spaces a level, cut below `depth` and after `max_entries`."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.slice(parts, F.lit(1), i).alias("parts"), (i < F.size(parts)).alias("folder")))
    nodes = paths.select(F.explode(each).alias("n")).select("n.*").where(F.col("depth") <= depth).distinct()
    first = nodes.orderBy("parts").limit(max_entries)
    name = F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.element_at("parts", -1), F.when(F.col("folder"), F.lit("/")).otherwise(F.lit("")), F.when(F.col("folder") & (F.col("depth") == depth), F.lit(" ...")).otherwise(F.lit("")))
    return first.select(F.row_number().over(W.orderBy("parts")).alias("place"), name.alias("line"))


def carry_forward(rows: DataFrame, partition: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """rows with the last non-null value up to each row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def ordered_distinct(rows: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """partition columns, value, first: each value once, where it first stands."""
    return rows.groupBy(*partition, value).agg(F.min(order).alias("first"))


def listing(rows: DataFrame, partition: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """rows with `place` and `total`, at most `limit` of each partition; total counts all."""
    by = W.partitionBy(*partition)
    return rows.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(*order))).where(F.col("place") <= limit)


def in_tests(path: Column) -> Column:
    """Whether a folder of the path is named test or tests, or the file's stem is conftest."""
    parts = F.split(path, "/")
    folder = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin("test", "tests"))
    return folder | (F.substring_index(F.element_at(parts, -1), ".", 1) == "conftest")


def line_count(text: Column) -> Column:
    """Lines; a last line feed ends a line and begins none."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n"), 0).otherwise(1))


def regroup(packed: DataFrame, partition: list[str]) -> DataFrame:
    """partition columns, shown, omitted of packed rows (`included`): a group that lost all its rows stays with its count."""
    return packed.groupBy(*partition).agg(F.count_if("included").alias("shown"), F.count_if(~F.col("included")).alias("omitted"))


def sticky_headers(slices: DataFrame, scopes: DataFrame) -> DataFrame:
    """path, start, header: lines of scopes to repeat above the slice that begins within them, each above its first such slice.

    `slices` has path, start; `scopes` path, line, end_line (null: open). As in refs.enclosing, spans are cut in blocks, and
    the range join is an equality on them.
    """
    block = 64
    starts = slices.select("path", "start").distinct()
    last = starts.groupBy("path").agg(F.max("start").alias("_last"))
    spans = scopes.join(last, "path").select("path", F.col("line").alias("header"), F.least(F.coalesce("end_line", F.col("_last")), F.col("_last")).alias("_end"))
    spans = spans.where("_end > header").withColumn("_block", F.explode(F.sequence(F.floor(F.col("header") / block), F.floor(F.col("_end") / block))))
    held = starts.withColumn("_block", F.floor(F.col("start") / block)).join(spans, ["path", "_block"]).where("header < start and start <= _end")
    return held.groupBy("path", "header").agg(F.min("start").alias("start")).select("path", "start", "header")


def first_members(members: DataFrame, group: str, member: str, shown: int, parts: int = 64) -> DataFrame:
    """group, member, place: the first `shown` members of each group in their order, by parts first, so that a group that
    holds much of the table is not sorted in one task."""
    part = F.pmod(F.hash(member), F.lit(parts))
    near = members.select(group, member).withColumn("_r", F.row_number().over(W.partitionBy(group, part).orderBy(member))).where(F.col("_r") <= shown)
    return near.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(member))).where(F.col("place") <= shown).select(group, member, "place")


def label_ordinals(rows: DataFrame, label: str, order: list[Column | str]) -> DataFrame:
    """rows with `title`: the label, and from its second row on its number."""
    n = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return rows.withColumn("title", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" "), n.cast("string"))))
