"""Names: counts, spreads, weights, look-ups, occurrences by file, callers.

Inputs are fact tables: symbols (path, name, line, end_line, ordinal), refs (path, name, line). Every result has a total
order given by its key columns; joins are on names or on (path, name), and Catalyst picks their strategy from sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.packing import in_tests
from codeloom.plans.lineage import cut


def occurrence_counts(refs: DataFrame) -> DataFrame:
    """path, name, n."""
    return refs.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))


def name_index(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """name, candidates (files that define it), spread (files that mention it, 0 if none) for each defined name."""
    defined = symbols.groupBy("name").agg(F.countDistinct("path").alias("candidates"))
    spread = refs.select("path", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("spread"))
    return defined.join(spread, "name", "left").select("name", "candidates", F.coalesce("spread", F.lit(0)).alias("spread"))


def multiplier(name: Column, noisy: Column) -> Column:
    """0.1 for names of at most two letters or in a stop list, else 1."""
    return F.when((F.length(name) <= 2) | noisy, 0.1).otherwise(1.0)


def damping(spread: Column) -> Column:
    """1 + ln(1 + spread); negative spreads count as 0."""
    return F.lit(1.0) + F.log(F.lit(1.0) + F.greatest(F.lit(0), spread))


def reference_weight(name: Column, count: Column, spread: Column, candidates: Column, noisy: Column) -> Column:
    """Occurrences times multiplier times 0.25 if one file defines the name, 0.05 if several do, by the damping."""
    return count * multiplier(name, noisy) * F.when(candidates == 1, 0.25).otherwise(0.05) / damping(F.coalesce(spread, F.lit(1)))


def stable_id(prefix: str = "txt") -> Column:
    """prefix:path::name, with #ordinal for repeats."""
    return F.concat(F.lit(prefix + ":"), F.col("path"), F.lit("::"), F.col("name"), F.when(F.col("ordinal") > 0, F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.lit("")))


def parse_id(id_: Column) -> tuple[Column, Column, Column]:
    """(path, name, ordinal) of a stable id."""
    rest = F.substring_index(id_, "::", -1)
    path = F.regexp_extract(id_, "^[^:]*:(.*)::[^:]*$", 1)
    ordinal = F.regexp_extract(rest, "#([0-9]+)$", 1)
    return path, F.regexp_replace(rest, "#[0-9]+$", ""), F.when(ordinal == "", F.lit(0)).otherwise(ordinal.try_cast("int"))


def find(symbols: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """The `limit` best matches: exact name, exact qualified name, prefix, substring; then by name, path, line. `total` counts all.

    A qualified name is looked at if symbols have `qualname`; `kind` keeps symbols of that kind.
    """
    needle = query.lower()
    low = F.lower("name")
    full = F.lower("qualname") if "qualname" in symbols.columns else low
    rank = F.when(low == needle, 0).when(full == needle, 1).when(low.startswith(needle), 2).otherwise(3)
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    hits = rows.where(F.contains(low, F.lit(needle)) | F.contains(full, F.lit(needle))).select(rank.alias("rank"), "name", "path", "line")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("rank", "name", "path", "line").limit(limit).join(F.broadcast(total))  # one row


def enclosing(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with the innermost symbol whose span holds the line: owner and owner_line, null outside all spans.

    Spans are cut in blocks of 64 lines, so the range join is an equality on (path, block) and a residual filter; a long
    span costs a row per block, not per line.
    """
    block = 64
    ends = F.coalesce("end_line", F.lit(1 << 30))
    sites = refs.select("path", "line").distinct()
    last = sites.groupBy("path").agg(F.max("line").alias("_last"))  # later blocks hold no site
    spans = symbols.join(last, "path").select("path", F.col("name").alias("owner"), F.col("line").alias("owner_line"), F.least(ends, F.col("_last")).alias("_end"), "ordinal")
    spans = spans.where("_end >= owner_line").withColumn("_block", F.explode(F.sequence(F.floor(F.col("owner_line") / block), F.floor(F.col("_end") / block))))
    held = sites.withColumn("_block", F.floor(F.col("line") / block)).join(spans, ["path", "_block"]).where(F.col("line").between(F.col("owner_line"), F.col("_end")))
    best = held.groupBy("path", "line").agg(F.max("owner_line").alias("owner_line"))
    named = symbols.groupBy("path", F.col("line").alias("owner_line")).agg(F.min_by("name", "ordinal").alias("owner"))
    return refs.join(best.join(named, ["path", "owner_line"]).select("path", "line", "owner", "owner_line"), ["path", "line"], "left").select(*refs.columns, "owner", "owner_line")


def references_to(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """path, name, line of each definition with `sites`, its mentions outside its own span."""
    d = symbols.select(F.col("path").alias("def_path"), "name", F.col("line").alias("def_line"), F.coalesce("end_line", F.lit(1 << 30)).alias("def_end"))
    # mentions in other files are a count by name less the file's own; only the own file needs lines
    by_name = refs.groupBy("name").agg(F.count(F.lit(1)).alias("all"))
    own = refs.withColumnRenamed("path", "def_path").join(d, ["def_path", "name"]).where(F.col("line").between(F.col("def_line"), F.col("def_end")))
    inside = own.groupBy("def_path", "name", "def_line").agg(F.count(F.lit(1)).alias("inside"))
    out = d.join(by_name, "name", "left").join(inside, ["def_path", "name", "def_line"], "left")
    return out.select(F.col("def_path").alias("path"), "name", F.col("def_line").alias("line"), (F.coalesce("all", F.lit(0)) - F.coalesce("inside", F.lit(0))).alias("sites"))


def sites_by_file(refs: DataFrame, name: str, shown: int = 5) -> DataFrame:
    """path, n, lines: the files that mention a name, most first, with the first lines."""
    sites = refs.where(F.col("name") == name).select("path", "line").distinct()
    ranked = sites.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("line")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.col("line")))), lambda x: x.cast("string")), ",")
    return ranked.groupBy("path").agg(F.count(F.lit(1)).alias("n"), lines.alias("lines"))


def shared_callers(symbols: DataFrame, refs: DataFrame, target: str, noisy: DataFrame | None = None) -> DataFrame:
    """What else the callers of `target` call: candidate, score, files, callers; a file votes by its most focused caller.

    A caller is a symbol whose span mentions the target. Its vote for each other defined name in its span is 1 by the
    damping of the number of such names; a candidate's score sums the best vote of each file, times its multiplier, by
    the damping of its spread. Candidates with one caller only are left out.
    """
    sites = refs.where(F.col("name") == target).select("path", "line").distinct()
    callers = cut(enclosing(sites, symbols).where("owner is not null").select("path", "owner", "owner_line").distinct())
    near = callers.select("path").distinct()  # only these files' words are joined with spans
    owned = enclosing(refs.join(near, "path", "left_semi"), symbols.join(near, "path", "left_semi")).where("owner is not null")
    called = owned.join(callers, ["path", "owner", "owner_line"]).select("path", "owner", "owner_line", "name").distinct()
    index = name_index(symbols, refs)
    called = called.join(index, "name").where((F.col("name") != target) & (F.col("name") != F.col("owner")))
    degree = called.groupBy("path", "owner", "owner_line").agg(F.count(F.lit(1)).alias("degree"))
    votes = called.join(degree, ["path", "owner", "owner_line"]).withColumn("vote", 1 / damping(F.col("degree")))
    per_file = votes.groupBy("name", "path").agg(F.max("vote").alias("vote"), F.count(F.lit(1)).alias("callers"), F.first("spread").alias("spread"))
    out = per_file.groupBy("name").agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("files"), F.sum("callers").alias("callers"), F.first("spread").alias("spread")).where("callers > 1")
    noise = F.lit(False)
    if noisy is not None:
        out = out.join(noisy.select("name").distinct().withColumn("_noisy", F.lit(True)), "name", "left")
        noise = F.coalesce("_noisy", F.lit(False))
    score = F.col("votes") * multiplier(F.col("name"), noise) / damping(F.col("spread"))
    return out.select(F.col("name").alias("candidate"), F.round(score, 6).alias("score"), "files", "callers")


def order_shared(rows: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` shared callers with `id` and `in_tests`: names defined outside tests first, then by score, files, id."""
    # one row for each name: its first definition outside tests, else its first
    named = symbols.select(F.col("name").alias("candidate"), in_tests(F.col("path")).alias("in_tests"), stable_id().alias("id"))
    first = named.groupBy("candidate").agg(F.min(F.struct("in_tests", "id")).alias("d")).select("candidate", "d.*")
    best = rows.join(first, "candidate").orderBy("in_tests", F.desc("score"), F.desc("files"), "id").limit(limit)
    return best.withColumn("place", F.row_number().over(W.orderBy("in_tests", F.desc("score"), F.desc("files"), "id")))  # `limit` rows


def body_keys(symbols: DataFrame, files: DataFrame, least: int = 12) -> DataFrame:
    """symbols with `body_key`: of the lines below the declaration, white space aside; null for fewer than `least` words.

    For languages without a token stream. The declaration's own line does not count, so a renamed copy has the same key.
    """
    lines = files.select("path", F.split("text", "\n", -1).alias("_lines"))
    size = F.least(F.coalesce("end_line", F.size("_lines")), F.size("_lines")) - F.col("line")
    body = F.array_join(F.slice("_lines", F.col("line") + 1, F.greatest(size, F.lit(0))), "\n")
    stream = F.trim(F.regexp_replace(body, "[ \\t\\n\\x0B\\f\\r]+", " "))
    key = F.when((F.col("_stream") != "") & (F.size(F.split("_stream", " ")) >= least), F.sha2("_stream", 256))
    return symbols.join(lines, "path").withColumn("_stream", stream).withColumn("body_key", key).select(*symbols.columns, "body_key")


def near_names(wanted: DataFrame, known: DataFrame, most: int = 2, top: int = 3) -> DataFrame:
    """name, near, distance: the `top` known names within `most` edits (at most 2) of each wanted name, least distance first.

    Two strings within k edits have a common string that each reaches by at most k deletions, so both sides are joined on
    those: an equality join instead of comparing all with all. Underscores and case do not count.
    """
    if not 0 <= most <= 2:
        raise ValueError("at most 2 edits")

    def folded(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("name").alias(name)).distinct().withColumn("f", F.lower(F.replace(F.col(name), F.lit("_"), F.lit(""))))

    def deletions(f: Column) -> Column:
        def drop(s: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

        out = F.array(f)
        for _ in range(most):
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))
        return out

    a = folded(wanted, "name").withColumn("key", F.explode(deletions(F.col("f"))))
    b = folded(known, "near").withColumnRenamed("f", "g").withColumn("key", F.explode(deletions(F.col("g"))))
    pairs = a.join(b, "key").where("name <> near").select("name", "near", "f", "g").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("f", "g", most)).where("distance >= 0")
    best = W.partitionBy("name").orderBy("distance", "near")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("name", "near", "distance")
