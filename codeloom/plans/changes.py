"""Registered queries over code, patches and findings: texts and fact tables written from the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import edits, lint
from codeloom.plans.queries import query
from codeloom.sources import code, patches
from codeloom.sources.facts import read

_MODULES = """modules AS (SELECT p_partkey AS k, 'pkg/part_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, p_size, CAST(p_partkey AS VARCHAR) AS s, CAST(p_partkey % 5 AS VARCHAR) AS five, CAST(p_partkey % 7 AS VARCHAR) AS seven FROM part)"""


def _text(form: str, **columns) -> F.Column:
    """`form` with each {name} put in."""
    names = list(columns)
    for i, n in enumerate(names):
        form = form.replace("{" + n + "}", f"%{i + 1}$s")
    return F.format_string(form, *[c.cast("string") for c in columns.values()])


def _modules(spark, sf_dir) -> DataFrame:
    """path, lang, text: a Python module for each part; every eleventh can't be read."""
    k = F.col("p_partkey")
    form = (
        "import os\nfrom pkg.mod{seven} import base{five}\nLIMIT_{k} = {size}\nclass Part{k}(Base{five}):\n    '''About {k}.'''\n    def price(self, n):\n        return n * {k}\n"
        "def make_{k}(a, b=1):\n    return base{five}(a)\n"
    )
    text = _text(form, k=k, five=k % 5, seven=k % 7, size=F.col("p_size"))
    broken = F.concat(text, F.lit("def broken(:\n"))
    return read(spark, sf_dir, "part").select(_text("pkg/part_{k}.py", k=k).alias("path"), F.lit("python").alias("lang"), F.when(k % 11 == 0, broken).otherwise(text).alias("text"))


@query(
    f"WITH {_MODULES} SELECT path, 'LIMIT_' || s AS name, 'constant' AS kind, 3::BIGINT AS line, 3::BIGINT AS end_line, '' AS parent, 'LIMIT_' || s || ' = ' || CAST(p_size AS VARCHAR) AS signature, '' AS docstring FROM modules WHERE k % 11 <> 0"
    " UNION ALL SELECT path, 'Part' || s, 'class', 4, 7, '', 'class Part' || s || '(Base' || five || ')', 'About ' || s || '.' FROM modules WHERE k % 11 <> 0"
    " UNION ALL SELECT path, 'price', 'method', 6, 7, 'Part' || s, 'def price(self, n)', '' FROM modules WHERE k % 11 <> 0"
    " UNION ALL SELECT path, 'make_' || s, 'function', 8, 9, '', 'def make_' || s || '(a, b=1)', '' FROM modules WHERE k % 11 <> 0"
)
def python_symbols(spark, sf_dir):
    s = code.symbols(code.extract(_modules(spark, sf_dir), ["symbol"]))
    return s.select("path", "name", "kind", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "parent", "signature", "docstring")


@query(f"WITH {_MODULES} SELECT path AS importer, 'os' AS module, '' AS names, 0::BIGINT AS level, 1::BIGINT AS line FROM modules WHERE k % 11 <> 0 UNION ALL SELECT path, 'pkg.mod' || seven, 'base' || five, 0, 2 FROM modules WHERE k % 11 <> 0")
def python_imports(spark, sf_dir):
    i = code.imports(code.extract(_modules(spark, sf_dir), ["import"]))
    return i.select("importer", "module", F.array_join("names", ",").alias("names"), F.col("level").cast("long").alias("level"), F.col("line").cast("long").alias("line"))


@query(f"WITH {_MODULES} SELECT path, 'Base' || five AS name, 4::BIGINT AS line FROM modules WHERE k % 11 <> 0 UNION ALL SELECT path, 'base' || five, 9 FROM modules WHERE k % 11 <> 0 UNION ALL SELECT path, 'LIMIT_' || s, 3 FROM modules WHERE k % 11 <> 0")
def python_references(spark, sf_dir):
    """What other files may define; the binding of an upper-case name at the top of a module counts as a reference too."""
    r = code.references(code.extract(_modules(spark, sf_dir), ["reference"]))
    return r.select("path", "name", F.col("line").cast("long").alias("line"))


@query(f"WITH {_MODULES} SELECT path FROM modules WHERE k % 11 = 0")
def skipped_files(spark, sf_dir):
    return code.skipped(code.extract(_modules(spark, sf_dir), ["skipped"])).select("path")


def _candidates(spark, sf_dir) -> DataFrame:
    """candidate, text: an edit for each part, by turns as marked block, unified diff and JSON; some blocks never end."""
    k = F.col("p_partkey")
    block = "src/f{k}.py\n<<<<<<< SEARCH\nx = {k}\n=======\nx = {next}\n"
    diff = "--- a/src/f{k}.py\n+++ b/src/f{k}.py\n@@ -1,2 +1,2 @@\n import os\n-x = {k}\n+x = {next}\n"
    typed = '{"edits": [{"path": "src/f{k}.py", "search": "x = {k}", "replace": "x = {next}"}]}'
    put = lambda form: _text(form, k=k, next=k + 1)
    whole = F.concat(put(block), F.when(k % 5 == 4, "").otherwise(">>>>>>> REPLACE\n"))
    text = F.when(k % 3 == 0, whole).when(k % 3 == 1, put(diff)).otherwise(put(typed))
    return read(spark, sf_dir, "part").select(_text("c{k}", k=k).alias("candidate"), text.alias("text"))


_EDITS = """edits AS (SELECT p_partkey AS k, 'c' || CAST(p_partkey AS VARCHAR) AS candidate, 'src/f' || CAST(p_partkey AS VARCHAR) || '.py' AS path, p_partkey % 3 = 0 AND p_partkey % 5 = 4 AS failed,
 CASE WHEN p_partkey % 3 = 1 THEN 'import os' || chr(10) ELSE '' END AS pre FROM part)"""


@query(f"WITH {_EDITS} SELECT candidate, 0::BIGINT AS at, path, pre || 'x = ' || CAST(k AS VARCHAR) AS search, pre || 'x = ' || CAST(k + 1 AS VARCHAR) AS replace FROM edits WHERE NOT failed")
def parsed_edits(spark, sf_dir):
    e = patches.parse(_candidates(spark, sf_dir)).where("error is null")
    return e.select("candidate", F.col("at").cast("long").alias("at"), "path", "search", "replace")


@query(f"WITH {_EDITS} SELECT candidate FROM edits WHERE failed")
def malformed_edits(spark, sf_dir):
    return patches.parse(_candidates(spark, sf_dir)).where("error is not null").select("candidate").distinct()


@query(
    f"WITH {_EDITS}, t AS (SELECT *, 'import os' || chr(10) || 'x = ' || CAST(k AS VARCHAR) AS old, 'import os' || chr(10) || 'x = ' || CAST(k + 1 AS VARCHAR) AS new FROM edits WHERE NOT failed)"
    " SELECT candidate, path, CASE k % 4 WHEN 0 THEN 'no_such_file' WHEN 1 THEN 'ambiguous' ELSE 'applied' END AS status, CASE k % 4 WHEN 0 THEN 0::BIGINT WHEN 1 THEN 2::BIGINT ELSE 1::BIGINT END AS matches, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN old || chr(10) || old ELSE new END AS text FROM t"
)
def applied_edits(spark, sf_dir):
    """The edits applied to files of which some are not there and some hold the searched lines twice."""
    k = F.col("p_partkey")
    once = _text("import os\nx = {k}", k=k)
    files = read(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(_text("src/f{k}.py", k=k).alias("path"), F.when(k % 4 == 1, F.concat(once, F.lit("\n"), once)).otherwise(once).alias("text"))
    out = edits.apply_edits(patches.parse(_candidates(spark, sf_dir)), files)
    return out.select("candidate", "path", "status", F.col("matches").cast("long").alias("matches"), "text")


_CHANGES = """tree AS (SELECT s_suppkey AS k, 'lib/s' || CAST(s_suppkey AS VARCHAR) || '.py' AS path, 'fn_' || CAST(s_suppkey % 40 AS VARCHAR) AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 'k' || CAST(s_suppkey % 30 AS VARCHAR) END AS body_key FROM supplier),
 added AS (SELECT c_custkey AS k, 'c' || CAST(c_custkey % 50 AS VARCHAR) AS candidate, 'lib/s' || CAST(c_custkey % 150 AS VARCHAR) || '.py' AS path, 'fn_' || CAST(c_custkey % 60 AS VARCHAR) AS name, CAST(c_custkey AS INTEGER) AS line, CASE WHEN c_custkey % 9 <> 0 THEN 'k' || CAST(c_custkey % 45 AS VARCHAR) END AS body_key FROM customer),
 removed AS (SELECT DISTINCT candidate, path, name FROM added WHERE k % 4 = 0)"""


def _changed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols of a tree, and those that candidates add and remove."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    tree = read(spark, sf_dir, "supplier").select(_text("lib/s{k}.py", k=k).alias("path"), _text("fn_{n}", n=k % 40).alias("name"), F.lit("").alias("parent"), F.when(k % 7 != 0, _text("k{n}", n=k % 30)).alias("body_key"))
    added = read(spark, sf_dir, "customer").select(_text("c{n}", n=c % 50).alias("candidate"), _text("lib/s{n}.py", n=c % 150).alias("path"), _text("fn_{n}", n=c % 60).alias("name"), F.lit("").alias("parent"), c.cast("int").alias("line"), F.when(c % 9 != 0, _text("k{n}", n=c % 45)).alias("body_key"))
    return tree, added, added.where("line % 4 = 0").select("candidate", "path", "name")


@query(
    f"WITH {_CHANGES}, known AS (SELECT name, min(path) AS first, count(*) AS n FROM tree GROUP BY name) SELECT candidate, 'shadowing' AS \"check\", 'advisory' AS severity, path, line, name || ' is already defined' AS message, first || CASE WHEN n > 1 THEN ' and ' || CAST(n - 1 AS VARCHAR) || ' more' ELSE '' END AS evidence FROM added ANTI JOIN removed USING (candidate, path, name) JOIN known USING (name)"
)
def lint_shadowing(spark, sf_dir):
    tree, added, removed = _changed(spark, sf_dir)
    return lint.shadowing(added, removed, tree)


@query(
    f"WITH {_CHANGES} SELECT candidate, 'near_duplicates' AS \"check\", 'advisory' AS severity, path, line, 'body of ' || name || ' is a copy' AS message, min(p || '::' || n) AS evidence FROM (SELECT a.*, t.path AS p, t.name AS n FROM added a JOIN tree t USING (body_key) WHERE NOT (a.path = t.path AND a.name = t.name)) x"
    " WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.candidate = x.candidate AND r.path = x.p AND r.name = x.n) GROUP BY candidate, path, name, line"
)
def lint_near_duplicates(spark, sf_dir):
    tree, added, removed = _changed(spark, sf_dir)
    return lint.near_duplicates(added, removed, tree)


@query(
    "WITH i AS (SELECT 'c' || CAST(c_custkey % 50 AS VARCHAR) AS candidate, 'app/m' || CAST(c_custkey AS VARCHAR) || '.py' AS path, CASE c_custkey % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'mod_' || CAST(c_custkey % 20 AS VARCHAR) || '.part' ELSE 'near' END AS module, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS level, CAST(c_custkey AS INTEGER) AS line, c_custkey % 20 AS n FROM customer)"
    " SELECT candidate, 'undeclared_imports' AS \"check\", 'warning' AS severity, path, line, 'imports undeclared ' || split_part(module, '.', 1) AS message, module AS evidence FROM i WHERE level = 0 AND starts_with(module, 'mod_') AND n >= 5 AND n NOT IN (7, 9)"
)
def lint_undeclared_imports(spark, sf_dir):
    """Modules of the standard library, declared (mod_0 to mod_4), imported elsewhere (mod_7) and in the tree (mod_9) pass."""
    c = F.col("c_custkey")
    module = F.when(c % 3 == 0, "os.path").when(c % 3 == 1, _text("mod_{n}.part", n=c % 20)).otherwise("near")
    imported = read(spark, sf_dir, "customer").select(_text("c{n}", n=c % 50).alias("candidate"), _text("app/m{n}.py", n=c).alias("path"), module.alias("module"), F.when(c % 3 == 2, 1).otherwise(0).alias("level"), c.alias("line"))
    declared = spark.range(5).select(_text("Mod.{n}", n=F.col("id")).alias("name"))
    elsewhere = spark.createDataFrame([("mod_7.x", 0)], "module string, level int")
    return lint.undeclared_imports(imported, declared, elsewhere, spark.createDataFrame([("mod_9/x.py",)], "path string"))


@query(
    "WITH d AS (SELECT 'fn_' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 3 AS required, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 3 + s_suppkey % 2 END AS total FROM supplier WHERE s_suppkey % 5 <> 0),"
    " c AS (SELECT 'c' || CAST(c_custkey % 50 AS VARCHAR) AS candidate, 'app/m.py' AS path, 'fn_' || CAST(c_custkey % 120 AS VARCHAR) AS name, CAST(c_custkey AS INTEGER) AS line, c_custkey % 4 AS arguments FROM customer)"
    " SELECT candidate, 'arity' AS \"check\", 'warning' AS severity, path, line, name || ' is called with ' || CAST(arguments AS VARCHAR) || ' arguments' AS message,"
    " 'takes ' || CASE WHEN total IS NULL THEN CAST(required AS VARCHAR) || ' or more' WHEN total = required THEN CAST(total AS VARCHAR) ELSE CAST(required AS VARCHAR) || ' to ' || CAST(total AS VARCHAR) END AS evidence FROM c JOIN d USING (name) WHERE arguments < required OR arguments > total"
)
def lint_arity(spark, sf_dir):
    """Calls of functions that take a range of arguments; decorated ones (every fifth) are left alone."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    shape = [F.lit("function").alias("kind"), F.when(k % 5 == 0, F.array(F.lit("wraps"))).otherwise(F.array().cast("array<string>")).alias("decorators"), (k % 3).cast("int").alias("required"), F.when(k % 7 != 0, k % 3 + k % 2).cast("int").alias("total")]
    tree = read(spark, sf_dir, "supplier").select(_text("fn_{k}", k=k).alias("name"), *shape)
    calls = read(spark, sf_dir, "customer").select(_text("c{n}", n=c % 50).alias("candidate"), F.lit("app/m.py").alias("path"), _text("fn_{n}", n=c % 120).alias("name"), c.alias("line"), (c % 4).cast("int").alias("arguments"))
    return lint.arity(calls, tree, tree.where("false").withColumn("candidate", F.lit("")))
