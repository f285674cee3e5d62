"""Checks of candidate changes against the facts of a tree: one finding a row, in one schema.

Inputs are fact tables of both sides: `added` and `removed` symbols (candidate, path, name, ...), `used` names, `imported`
modules, and the tree's symbols, references and imports. Each check is a chain of semi and anti joins on names; what a
check could not look at becomes a finding of severity not_checked.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.refs import near_names

COLUMNS = ["candidate", "check", "severity", "path", "line", "message", "evidence"]


def _finding(df: DataFrame, check: str, severity: str, message: Column, evidence: Column) -> DataFrame:
    line = F.col("line").cast("int") if "line" in df.columns else F.lit(None).cast("int")
    return df.select("candidate", F.lit(check).alias("check"), F.lit(severity).alias("severity"), "path", line.alias("line"), message.alias("message"), evidence.cast("string").alias("evidence"))


def undeclared_imports(imported: DataFrame, declared: DataFrame, tree_imports: DataFrame, tree_files: DataFrame) -> DataFrame:
    """Absolute imports whose top package is neither in the standard library, nor declared, nor imported elsewhere, nor in the tree."""
    spark = imported.sparkSession
    top = F.split_part("module", F.lit("."), F.lit(1))
    rows = imported.where("level = 0").withColumn("name", top)
    standard = spark.createDataFrame([(x,) for x in sorted(sys.stdlib_module_names)], "name string")
    folded = lambda c: F.lower(F.regexp_replace(c, "[-_.]+", "-"))
    rows = rows.join(F.broadcast(standard), "name", "left_anti")  # a few hundred names
    rows = rows.join(declared.select(folded(F.col("name")).alias("n")).distinct(), folded(F.col("name")) == F.col("n"), "left_anti")
    rows = rows.join(tree_imports.where("level = 0").select(top.alias("name")).distinct(), "name", "left_anti")
    parts = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    rows = rows.join(tree_files.select(F.explode(parts).alias("name")).distinct(), "name", "left_anti")
    return _finding(rows, "undeclared_imports", "warning", F.concat(F.lit("imports undeclared "), "name"), F.col("module"))


def shadowing(added: DataFrame, removed: DataFrame, tree_symbols: DataFrame) -> DataFrame:
    """New module-level names that the tree already defines, unless the change replaces that definition."""
    rows = added.where("parent = ''").join(removed.select("candidate", "path", "name").distinct(), ["candidate", "path", "name"], "left_anti")
    known = tree_symbols.where("parent = ''").groupBy("name").agg(F.min("path").alias("where"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(known, "name")
    return _finding(rows, "shadowing", "advisory", F.concat("name", F.lit(" is already defined")), F.concat("where", F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise(F.lit(""))))


def near_duplicates(added: DataFrame, removed: DataFrame, tree_symbols: DataFrame) -> DataFrame:
    """New bodies equal to one in the tree (body_key), other than the one they replace.

    The tree's definitions of a key stand in one order; what a change removes are places in it. So the first that a change
    leaves is found from gaps between its places, the second serves the definition that is itself the first, and no pair of
    an added and a known definition is made.
    """
    named = F.concat("p", F.lit("::"), "n")
    known = tree_symbols.where("body_key is not null").select("body_key", F.col("path").alias("p"), F.col("name").alias("n")).where(named.isNotNull()).distinct()
    known = known.withColumn("same", named).withColumn("place", F.row_number().over(W.partitionBy("body_key").orderBy("same", "p", "n")))
    rows = added.where("body_key is not null and path is not null and name is not null")
    groups = rows.select("candidate", "body_key").distinct()
    gone = removed.select("candidate", F.col("path").alias("p"), F.col("name").alias("n")).distinct().join(known, ["p", "n"]).join(groups, ["candidate", "body_key"], "left_semi")
    below = F.col("place") - F.row_number().over(W.partitionBy("candidate", "body_key").orderBy("place"))  # places before it that are left
    free = gone.select("candidate", "body_key", below.alias("below")).groupBy("candidate", "body_key").agg(F.count_if(F.col("below") == 0).alias("a"), F.count_if(F.col("below") <= 1).alias("b"))
    free = groups.join(free, ["candidate", "body_key"], "left").select("candidate", "body_key", F.explode(F.array(F.coalesce("a", F.lit(0)) + 1, F.coalesce("b", F.lit(0)) + 2)).alias("place"))
    left = free.join(known, ["body_key", "place"]).groupBy("candidate", "body_key").agg(F.array_sort(F.collect_list(F.struct("place", "same", "p", "n"))).alias("left"))
    other = F.filter("left", lambda x: (x["p"] != F.col("path")) | (x["n"] != F.col("name")))
    rows = rows.join(left, ["candidate", "body_key"]).withColumn("same", F.get(other, F.lit(0))["same"]).where("same is not null")
    rows = rows.groupBy("candidate", "path", "name", "line").agg(F.min("same").alias("same"))
    return _finding(rows, "near_duplicates", "advisory", F.concat(F.lit("body of "), "name", F.lit(" is a copy")), F.col("same"))


def dangling_references(used: DataFrame, added: DataFrame, removed: DataFrame, tree_symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """Names the change uses that nothing binds: not built in, not bound by the change, not defined in the tree; with near misses."""
    spark = used.sparkSession
    import builtins

    always = spark.createDataFrame([(x,) for x in dir(builtins)], "name string")
    gone = removed.join(added.select("candidate", "path", "name"), ["candidate", "path", "name"], "left_anti").select("candidate", "path", "name").distinct()
    rows = used.join(F.broadcast(always), "name", "left_anti").join(bound.select("candidate", "name").distinct(), ["candidate", "name"], "left_anti")  # a few hundred names
    left = rows.join(tree_symbols.select("name", F.col("path").alias("p")).distinct(), "name", "left").join(gone.select("candidate", F.col("path").alias("p"), "name", F.lit(True).alias("g")), ["candidate", "p", "name"], "left")
    keys = ["candidate", "path", "name", "line"]
    rows = left.groupBy(*keys).agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNull()).alias("n")).where("n = 0")
    near = near_names(rows.select("name").distinct(), tree_symbols.select("name").distinct())
    near = near.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "near"))), lambda x: x["near"]), ", ").alias("near"))
    rows = rows.join(near, "name", "left")
    return _finding(rows, "dangling_references", "warning", F.concat("name", F.lit(" is not defined")), F.coalesce(F.concat(F.lit("did you mean "), "near"), F.lit("")))


def dangling_callers(removed: DataFrame, added: DataFrame, tree_symbols: DataFrame, tree_refs: DataFrame, touched: DataFrame, shown: int = 5) -> DataFrame:
    """Names the change removes, defined nowhere else, that untouched files still mention; some sites, and their number."""
    rows = removed.join(added.select("candidate", "name").distinct(), ["candidate", "name"], "left_anti").select("candidate", "path", "name").distinct()
    files = touched.select("candidate", F.col("path").alias("p"), F.lit(True).alias("t")).distinct()
    others = rows.select("candidate", "name").distinct().join(tree_symbols.select("name", F.col("path").alias("p")).distinct(), "name").join(files, ["candidate", "p"], "left").where("t is null")
    rows = rows.join(others.select("candidate", "name").distinct(), ["candidate", "name"], "left_anti")
    sites = rows.join(tree_refs.select("name", F.col("path").alias("p"), F.col("line").alias("l")), "name").join(files, ["candidate", "p"], "left").where("t is null")
    by = W.partitionBy("candidate", "path", "name").orderBy("p", "l")
    sites = sites.withColumn("r", F.row_number().over(by))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("p", "l")))), lambda x: F.concat(x["p"], F.lit(":"), x["l"].cast("string"))), ", ")
    sums = sites.groupBy("candidate", "path", "name").agg(F.count(F.lit(1)).alias("n"), text.alias("sites"))
    return _finding(sums, "dangling_callers", "warning", F.concat("name", F.lit(" is removed but used at "), F.col("n").cast("string"), F.lit(" sites")), F.col("sites"))


def arity(calls: DataFrame, tree_symbols: DataFrame, added: DataFrame) -> DataFrame:
    """Calls with more or fewer arguments than the one plain undecorated function of that name takes; silent if in doubt."""
    shapes = added.select("candidate", "name", "kind", "decorators", "required", "total")
    tree = tree_symbols.select("name", "kind", "decorators", "required", "total")
    names = calls.select("candidate", "name").distinct()
    defs = names.join(tree, "name").join(shapes.select("candidate", "name").distinct(), ["candidate", "name"], "left_anti").unionByName(names.join(shapes, ["candidate", "name"], "inner").select("candidate", "name", "kind", "decorators", "required", "total"))
    one = defs.groupBy("candidate", "name").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"), F.first(F.size("decorators")).alias("d"), F.first("required").alias("required"), F.first("total").alias("total"))
    one = one.where("n = 1 and kind = 'function' and d = 0 and required is not null")
    rows = calls.where("arguments is not null").join(one, ["candidate", "name"]).where("arguments < required or arguments > total")
    takes = F.when(F.col("total").isNull(), F.concat(F.col("required").cast("string"), F.lit(" or more"))).when(F.col("total") == F.col("required"), F.col("total").cast("string")).otherwise(F.concat(F.col("required").cast("string"), F.lit(" to "), F.col("total").cast("string")))
    return _finding(rows, "arity", "warning", F.concat("name", F.lit(" is called with "), F.col("arguments").cast("string"), F.lit(" arguments")), F.concat(F.lit("takes "), takes))


def new_cycles(before: DataFrame, after: DataFrame) -> DataFrame:
    """candidate, files: import cycles (component, node) after a change that are not there before, as sets of files."""
    sets = lambda df, *k: df.groupBy(*k, "component").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("files"))
    rows = sets(after, "candidate").join(sets(before).select("files").distinct(), "files", "left_anti")
    rows = rows.withColumn("path", F.col("component"))
    return _finding(rows, "cycle_delta", "warning", F.lit("the change closes an import cycle"), F.col("files"))


def not_checked(skipped: DataFrame, check: str) -> DataFrame:
    """Findings for what a check could not look at (candidate, path, reason)."""
    return _finding(skipped, check, "not_checked", F.lit("could not be examined"), F.col("reason"))


def report(*findings: DataFrame) -> DataFrame:
    """All findings with `place`, their total order within a candidate."""
    all_ = reduce(DataFrame.unionByName, findings)
    return all_.withColumn("place", F.row_number().over(W.partitionBy("candidate").orderBy("check", "path", F.col("line").asc_nulls_first(), "message", "evidence")))
