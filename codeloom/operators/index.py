"""Incremental index: what to reuse, extract anew, drop; generations; equal contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status of each path in either table (path, sha256, version): reuse, extract (new or changed), prune (gone)."""
    a = current.select("path", F.col("sha256").alias("_a"), F.col("version").alias("_va"))
    b = stored.select("path", F.col("sha256").alias("_b"), F.col("version").alias("_vb"))
    status = F.when(F.col("_a").isNull(), "prune").when(F.col("_b").isNull(), "extract_new").when((F.col("_a") == F.col("_b")) & (F.col("_va") == F.col("_vb")), "reuse").otherwise("extract_changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def cached_or_extracted(current: DataFrame, stored: DataFrame, facts: DataFrame, extract) -> DataFrame:
    """Facts of all current files: stored rows where path, sha256 and version agree, `extract(files)` for the others."""
    keys = ["path", "sha256", "version"]
    fresh = current.select(*keys).join(stored.select(*keys), keys, "left_semi")
    return facts.join(fresh, ["path"], "left_semi").unionByName(extract(current.join(stored.select(*keys), keys, "left_anti")))


def report(planned: DataFrame) -> DataFrame:
    """status, files."""
    return planned.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def generation(files: DataFrame) -> DataFrame:
    """generation, files: one digest of the sorted (path, size, sha256) manifest, through digests of its folders, so that
    no one task holds the manifest."""
    row = F.concat_ws("\0", "path", F.col("size").cast("string"), "sha256")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    each = files.groupBy(folder.alias("folder")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", "folder", "d"))), "\n"), 256).alias("generation"), F.sum("n").alias("files"))


def equal_contents(files: DataFrame) -> DataFrame:
    """key, size, representative: files whose texts are equal but for white space, two at least; the least path stands for them."""
    stream = F.trim(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " "))
    return files.groupBy(F.sha2(stream, 256).alias("key")).agg(F.count(F.lit(1)).alias("size"), F.min("path").alias("representative")).where("size > 1")


def equivalence_key(changes: DataFrame) -> DataFrame:
    """candidate, key: sha256 over the sorted `path NUL key LF` of a candidate's changed files (candidate, path, key)."""
    row = F.concat("path", F.lit("\0"), "key", F.lit("\n"))
    return changes.groupBy("candidate").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("key"))


def apply(planned: DataFrame, stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """The next generation's facts: stored rows of reused paths and the extracted rows of new and changed ones; the rest goes."""
    kept = stored.join(planned.where("status = 'reuse'").select("path"), "path", "left_semi")
    new = extracted.join(planned.where("status in ('extract_new', 'extract_changed')").select("path"), "path", "left_semi")
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def drift(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    """path, line, now, before: the first line in which two texts of a path (path, text) differ; a text's end shows as null."""
    lines = lambda df, c: df.select("path", F.posexplode(F.split("text", "\n", -1)).alias("_at", c))
    both = lines(rendered, "now").join(lines(stored, "before"), ["path", "_at"], "full_outer").where(~F.col("now").eqNullSafe(F.col("before")))
    first = both.groupBy("path").agg(F.min(F.struct((F.col("_at") + 1).cast("long").alias("line"), "now", "before")).alias("d"))
    return first.select("path", "d.*")
