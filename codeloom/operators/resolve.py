"""Resolution of names to definitions in tiers of evidence: same file, imported, unique, ambiguous.

The first tier that holds a candidate decides, and all its candidates are kept. Inputs are distinct (path, name) uses, the
symbols, and the import edges (src, dst). The join on names is one equality join; the tier of a use is a minimum over it,
so no candidate list is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIERS = ["same_file", "imported", "unique", "ambiguous"]


def candidates(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """path, name, target, tier_rank for each use and each file that defines the name."""
    defs = symbols.select("name", F.col("path").alias("target")).distinct()
    n = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    rows = uses.select("path", "name").distinct().join(defs.join(n, "name"), "name")
    known = imports.select(F.col("src").alias("path"), F.col("dst").alias("target"), F.lit(True).alias("imported")).distinct()
    rows = rows.join(known, ["path", "target"], "left")
    rank = F.when(F.col("path") == F.col("target"), 0).when(F.col("imported"), 1).when(F.col("n") == 1, 2).otherwise(3)
    return rows.select("path", "name", "target", rank.alias("tier_rank"))


def resolve(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """path, name, tier, targets (number of candidates in the deciding tier) of each use that some file defines.

    Counts only: equality joins for the own file and for what imports show, and a count by name for the rest.
    """
    defs = symbols.select("name", F.col("path").alias("target")).distinct()
    n = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    own = defs.select("name", F.col("target").alias("path"), F.lit(True).alias("own"))
    seen = imports.select(F.col("src").alias("path"), F.col("dst").alias("target")).distinct().join(defs, "target").groupBy("path", "name").agg(F.count(F.lit(1)).alias("seen"))
    rows = uses.select("path", "name").distinct().join(n, "name").join(own, ["path", "name"], "left").join(seen, ["path", "name"], "left")
    rank = F.when(F.col("own"), 1).when(F.col("seen") > 0, 2).when(F.col("n") == 1, 3).otherwise(4)
    targets = F.when(F.col("own"), F.lit(1).cast("long")).otherwise(F.coalesce("seen", "n"))
    return rows.select("path", "name", F.element_at(F.array(*map(F.lit, TIERS)), rank).alias("tier"), targets.alias("targets"))


def symbol_edges(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, name, relation, tier: reference edges of the deciding tier and import edges, without self edges."""
    c = candidates(uses, symbols, imports)
    best = c.groupBy("path", "name").agg(F.min("tier_rank").alias("tier_rank"))
    kept = c.join(best, ["path", "name", "tier_rank"])
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier_rank") + 1)
    refs = kept.select(F.col("path").alias("src"), F.col("target").alias("dst"), "name", F.lit("references").alias("relation"), tier.alias("tier"))
    named = imports.select("src", "dst", F.lit("").alias("name"), F.lit("imports").alias("relation"), F.lit("imported").alias("tier"))
    return refs.unionByName(named).where("src <> dst").distinct()


def edge_counts(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """src, relation, tier, edges, first (least dst), last_name (greatest name) over all rows of symbol_edges, which are not made.

    Every target of a use counts: a use that its own file defines leads nowhere else; what imports show is joined by
    (file, name); for the rest the number of definers and the least of them are facts of the name.
    """
    defs = symbols.select("name", F.col("path").alias("target")).distinct()
    of_name = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("least"))
    own = defs.select(F.col("target").alias("path"), "name")
    known = imports.select(F.col("src").alias("path"), F.col("dst").alias("target")).where("path <> target").distinct()
    seen = known.join(defs, "target").groupBy("path", "name").agg(F.count(F.lit(1)).alias("seen"), F.min("target").alias("nearest"))
    rows = uses.select("path", "name").distinct().join(own, ["path", "name"], "left_anti").join(seen, ["path", "name"], "left").join(of_name, "name")
    rank = F.when(F.col("seen") > 0, 1).when(F.col("n") == 1, 2).otherwise(3)
    tier = F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)
    refs = rows.select(F.col("path").alias("src"), F.lit("references").alias("relation"), tier.alias("tier"), F.coalesce("seen", "n").alias("edges"), F.coalesce("nearest", "least").alias("first"), "name")
    named = known.select(F.col("path").alias("src"), F.lit("imports").alias("relation"), F.lit("imported").alias("tier"), F.lit(1).cast("long").alias("edges"), F.col("target").alias("first"), F.lit("").alias("name"))
    return refs.unionByName(named).groupBy("src", "relation", "tier").agg(F.sum("edges").alias("edges"), F.min("first").alias("first"), F.max("name").alias("last_name"))


def tier_groups(edges: DataFrame, node: str, limit: int = 10) -> DataFrame:
    """tier, total, other, name: what leads out of a node by tier, at most `limit` each, `total` before the limit."""
    own = edges.where(F.col("src") == node)
    by = W.partitionBy("tier")
    rows = own.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("r", F.row_number().over(by.orderBy("dst", "name", "relation")))
    return rows.where(F.col("r") <= limit).select("tier", "total", F.col("dst").alias("other"), "name", "relation")


def import_targets(statements: DataFrame, paths: DataFrame, suffixes: tuple[str, ...] = (".py", "/__init__.py"), roots: tuple[str, ...] = ("", "src/")) -> DataFrame:
    """importer, module, target: the first path that a module names, else the shortest path that ends with it.

    `statements` has importer, module (dotted), level (leading dots). Candidates are exploded in order and joined by
    equality; the fallback joins on exploded path tails and serves absolute modules with a dot only.
    """
    rows = statements.select("importer", "module", "level").distinct().withColumn("m", F.replace("module", F.lit("."), F.lit("/")))
    parts = F.split("importer", "/")
    depth = F.greatest(F.size(parts) - F.col("level"), F.lit(0))
    folder = F.array_join(F.slice(parts, F.lit(1), depth), "/")
    near = F.when(folder == "", F.col("m")).when(F.col("m") == "", folder).otherwise(F.concat(folder, F.lit("/"), F.col("m")))
    sibling = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    bases = F.when(F.col("level") > 0, F.array(near)).otherwise(F.concat(F.array(*[F.concat(F.lit(r), F.col("m")) for r in roots]), F.array(F.concat_ws("/", sibling, F.col("m")))))
    tried = F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(s)) for s in suffixes])))
    known = rows.select("importer", "module", "level", "m", F.posexplode(tried).alias("ord", "path")).join(paths.select("path").distinct(), "path", "left_semi")
    first = known.groupBy("importer", "module", "level").agg(F.min_by("path", "ord").alias("exact"))
    tails = paths.select("path").distinct().withColumn("p", F.split("path", "/"))
    tails = tails.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("tail"))
    wide = rows.where((F.col("level") == 0) & F.contains("module", F.lit("."))).select("importer", "module", "level", F.explode(F.array(*[F.concat("m", F.lit(s)) for s in suffixes])).alias("tail"))
    loose = wide.join(tails, "tail").groupBy("importer", "module", "level").agg(F.min(F.struct(F.length("path").alias("n"), F.col("path"))).alias("l"))
    out = rows.join(first, ["importer", "module", "level"], "left").join(loose, ["importer", "module", "level"], "left")
    return out.select("importer", "module", "level", F.coalesce("exact", "l.path").alias("target")).where("target is not null and target <> importer")


def imported_submodules(statements: DataFrame, paths: DataFrame, **how) -> DataFrame:
    """importer, module, level, name, target: the names of `from module import name` that are modules themselves."""
    each = statements.select("importer", "module", "level", F.explode("names").alias("name")).distinct()
    probe = each.withColumn("_dotted", F.when(F.col("module") == "", F.col("name")).otherwise(F.concat("module", F.lit("."), "name")))
    found = import_targets(probe.select("importer", F.col("_dotted").alias("module"), "level"), paths, **how)
    return probe.join(found.withColumnRenamed("module", "_dotted"), ["importer", "_dotted", "level"]).select("importer", "module", "level", "name", "target")


def import_scopes(statements: DataFrame, paths: DataFrame, **how) -> DataFrame:
    """path, binding, kind, target: what a file's imports make known. kind `module` is a name bound to a file (a module
    imported whole by its last part, or a submodule); kind `file` is a file that a statement names, binding its dotted name."""
    whole = import_targets(statements, paths, **how)
    subs = imported_submodules(statements, paths, **how)
    bare = statements.where(F.size("names") <= 0).select("importer", "module", "level").distinct()
    modules = whole.join(bare, ["importer", "module", "level"], "left_semi").select("importer", F.substring_index("module", ".", -1).alias("binding"), "target")
    modules = modules.unionByName(subs.select("importer", F.col("name").alias("binding"), "target")).withColumn("kind", F.lit("module"))
    named = whole.select("importer", F.col("module").alias("binding"), "target").withColumn("kind", F.lit("file"))
    return modules.unionByName(named).select(F.col("importer").alias("path"), "binding", "kind", "target").distinct()


def module_attributes(uses: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, qualifier, name, target: uses of `qualifier.name` whose qualifier is bound to a file that defines the name."""
    bound = bindings.select("path", F.col("binding").alias("qualifier"), "target").distinct()
    defs = symbols.select(F.col("path").alias("target"), "name").distinct()
    return uses.select("path", "qualifier", "name").distinct().join(bound, ["path", "qualifier"]).join(defs, ["target", "name"]).select("path", "qualifier", "name", "target")


def lands_on(uses: DataFrame, symbols: DataFrame, imports: DataFrame, targets: DataFrame) -> DataFrame:
    """path, name, tier, lands: whether a candidate of the use's deciding tier lies in `targets` (path). Counts only, as in resolve."""
    wanted = targets.select(F.col("path").alias("target")).distinct()
    hit = symbols.select("name", F.col("path").alias("target")).distinct().join(wanted, "target", "left_semi")
    own = hit.select("name", F.col("target").alias("path"), F.lit(True).alias("_own"))
    seen = imports.select(F.col("src").alias("path"), F.col("dst").alias("target")).join(hit, "target").select("path", "name", F.lit(True).alias("_seen")).distinct()
    any_ = hit.select("name", F.lit(True).alias("_any")).distinct()
    rows = resolve(uses, symbols, imports).join(own, ["path", "name"], "left").join(seen, ["path", "name"], "left").join(any_, "name", "left")
    mark = F.when(F.col("tier") == "same_file", F.col("_own")).when(F.col("tier") == "imported", F.col("_seen")).otherwise(F.col("_any"))
    return rows.select("path", "name", "tier", F.coalesce(mark, F.lit(False)).alias("lands"))


def explain(edges: DataFrame, node: str, limit: int = 10) -> DataFrame:
    """direction, relation, tier, total, place, other, name: what leads out of a node and into it, at most `limit` of each
    relation and tier, `total` before the limit."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), "relation", "tier", F.col("dst").alias("other"), "name")
    into = edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), "relation", "tier", F.col("src").alias("other"), "name")
    group = ["direction", "relation", "tier"]
    rows = out.unionByName(into)
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    by = W.partitionBy(*group).orderBy("other", "name")
    top = rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)
    return top.join(totals, group).select(*group, "total", "place", "other", "name")
