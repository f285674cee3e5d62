"""What a request names: focus entries, stable ids or bare names, locations in a file. Unanswered requests stay as rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOW = ["path", "suffix", "stem", "qualified", "symbol"]


def _tails(path: Column) -> Column:
    """All ends of a path at a folder's edge, the whole among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def focus(entries: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """entry, path, how: the files that each entry names, by the first that fits of whole path, path end, path end without
    suffix, owner.name, name. An entry with a slash that fits no file names nothing.

    Ends are exploded once and joined by equality; the first fitting way is a minimum over an entry's rows.
    """
    e = entries.select("entry").distinct()
    paths = files.select("path").distinct()
    bare = F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", "")
    ends = paths.select("path", F.explode(_tails(F.col("path"))).alias("entry"))
    stems = paths.select("path", F.explode(_tails(bare)).alias("entry"))
    found = e.join(ends, "entry").select("entry", "path", F.when(F.col("entry") == F.col("path"), 0).otherwise(1).alias("rank"))
    found = found.unionByName(e.join(stems, "entry").select("entry", "path", F.lit(2).alias("rank")))
    named = e.withColumn("q", F.substring_index("entry", "::", -1)).where(~F.contains("q", F.lit("/"))).withColumn("name", F.substring_index("q", ".", -1))
    parent = F.col("parent") if "parent" in symbols.columns else F.lit("")
    own = symbols.select("path", "name", F.when(parent == "", F.col("name")).otherwise(F.concat(parent, F.lit("."), "name")).alias("qual")).distinct()
    by_name = named.join(own, "name").select("entry", "path", F.when(F.col("qual") == F.col("q"), 3).otherwise(4).alias("rank"))
    found = found.unionByName(by_name).distinct()
    best = found.groupBy("entry").agg(F.min("rank").alias("rank"))
    return found.join(best, ["entry", "rank"]).select("entry", "path", F.element_at(F.array(*map(F.lit, HOW)), F.col("rank") + 1).alias("how"))


def seeds(focused: DataFrame) -> DataFrame:
    """node, weight: each entry's weight of 1 spread over its files."""
    n = focused.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    return focused.join(n, "entry").groupBy(F.col("path").alias("node")).agg(F.sum(1 / F.col("n")).alias("weight"))


def definitions(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """target, path, name, line, place: by stable id the definition in its file, else every one of that name; best first."""
    path = F.regexp_extract("target", "^[^:]*:(.*)::[^:]*$", 1)
    rest = F.regexp_replace(F.substring_index("target", "::", -1), "#[0-9]+$", "")
    t = targets.select("target").distinct().select("target", path.alias("want"), rest.alias("qual"), F.substring_index(rest, ".", -1).alias("name"))
    rows = t.join(symbols.select("path", "name", "line").distinct(), "name").withColumn("exact", (F.col("want") == F.col("path")).cast("int"))
    by = W.partitionBy("target")
    rows = rows.withColumn("any", F.max("exact").over(by)).where("any = 0 or exact = 1")
    return rows.withColumn("place", F.row_number().over(by.orderBy("path", "line"))).select("target", "path", "name", "line", "place")


def within_limit(requests: DataFrame, order: str, limit: int) -> DataFrame:
    """requests with `answered` and, past the limit, a reason."""
    place = F.row_number().over(W.orderBy(order))
    rows = requests.withColumn("place", place).withColumn("answered", F.col("place") <= limit)
    return rows.withColumn("reason", F.when(~F.col("answered"), F.lit(f"past the limit of {limit}")))


def locations(locs: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """path, ord, loc, start, end, reason of location strings (path, ord, loc): `class: X`, `function: f`, `X.m`, `line: 7`,
    `variable: N`. A class is remembered for the functions after it; ambiguity and misses are reasons, never guesses.

    `symbols` has path, name, kind, parent, line, end_line, ordinal; `lines` has path, total.
    """
    form = F.when(F.col("loc").startswith("class:") & ~F.contains("loc", F.lit(".")), "class").when(F.col("loc").startswith("line:"), "line").when(F.col("loc").startswith("variable:"), "variable")
    form = form.when(F.col("loc").rlike("^(function|method):") | F.contains("loc", F.lit(".")), "function").otherwise("unknown")
    text = F.trim(F.when(F.contains("loc", F.lit(":")), F.regexp_replace("loc", "^[^:]*:", "")).otherwise(F.col("loc")))
    rows = locs.withColumn("form", form).withColumn("text", text).join(lines, "path", "left")
    rows = rows.withColumn("want", F.regexp_replace("text", "#[0-9]+$", "")).withColumn("ordinal_", F.coalesce(F.regexp_extract("text", "#([0-9]+)$", 1).try_cast("int") - 1, F.lit(0)))
    kinds = symbols.where(F.col("kind").isin("class", "protocol", "dataclass", "enum")).select("path", F.col("name").alias("c")).distinct()
    known = rows.join(kinds, (rows.path == kinds.path) & (rows.want == kinds.c) & (rows.form == "class"), "left").select(rows["*"], "c")
    order = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = known.withColumn("current", F.last("c", ignorenulls=True).over(order))
    name = F.when(F.col("form") == "variable", F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.substring_index("want", ".", -1))
    owner = F.when(F.contains("want", F.lit(".")), F.regexp_replace("want", r"\.[^.]*$", ""))
    known = known.withColumn("name", name).withColumn("owner", owner)
    s = symbols.select("path", "name", "kind", "parent", F.col("line").alias("s"), F.coalesce("end_line", "line").alias("e"), "ordinal")
    hit = known.join(s, ["path", "name"], "left")
    callable_ = F.col("kind").isin("function", "method")
    rank = (
        F.when((F.col("form") == "class") & F.col("kind").isin("class", "protocol", "dataclass", "enum"), 0)
        .when((F.col("form") == "variable") & (F.col("kind") == "constant"), 0)
        .when((F.col("form") == "function") & F.col("owner").isNotNull() & callable_ & (F.col("parent") == F.col("owner")), 0)
        .when((F.col("form") == "function") & F.col("owner").isNull() & (F.col("kind") == "function"), 1)
        .when((F.col("form") == "function") & F.col("owner").isNull() & (F.col("kind") == "method") & (F.col("parent") == F.col("current")), 2)
        .when((F.col("form") == "function") & F.col("owner").isNull() & (F.col("kind") == "method"), 3)
    )
    hit = hit.withColumn("rank", rank)
    keys = ["path", "ord", "loc", "form", "text", "total", "ordinal_"]
    best = hit.groupBy(*keys).agg(F.min("rank").alias("best"))
    of = hit.join(best.select("path", "ord", "best"), ["path", "ord"]).where("rank = best")
    chosen = of.groupBy("path", "ord").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"), F.countDistinct("parent").alias("owners"), F.min(F.when((F.col("ordinal") == F.col("ordinal_")) | (F.col("form") == "class") | (F.col("form") == "variable"), F.struct("s", "e"))).alias("p"))
    out = best.drop("best").join(chosen, ["path", "ord"], "left")
    line = F.regexp_extract("text", "^([0-9]+)", 1).try_cast("int")
    fine_line = line.isNotNull() & (line >= 1) & (F.col("total").isNull() | (line <= F.col("total")))
    reason = (
        F.when(F.col("form") == "unknown", "unknown location form")
        .when((F.col("form") == "line") & ~F.coalesce(fine_line, F.lit(False)), "no such line")
        .when(F.col("form") == "line", F.lit(None))
        .when(F.col("n").isNull(), "no such symbol")
        .when((F.col("best") == 3) & (F.col("owners") > 1), "ambiguous")
        .when(F.col("p").isNull(), "no such ordinal")
    )
    out = out.withColumn("reason", reason)
    pick = lambda x, y: F.when(F.col("reason").isNull(), F.when(F.col("form") == "line", x).otherwise(y))
    return out.select("path", "ord", "loc", pick(line, F.col("p.s")).alias("start"), pick(line, F.col("p.e")).alias("end"), "reason")
