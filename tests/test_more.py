"""Operators beside the registered queries: driver files, stores, envelopes, scopes, bound names."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import columns
from codeloom.operators import graph, index, packing, refs, render, resolve
from codeloom.sources import store


def test_bound_names_and_bases(spark):
    lines = ["a, b = f()", "  x: int = 3", "a == 1", "for i, j in k:", "with open(p) as f:", "if (n := g()) > 1:", "x <= 2", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(columns.bound_names(F.col("x"))).collect()]
    assert got == [["a", "b"], ["x"], [], ["i", "j"], ["f"], ["n"], [], []]
    bases = ["Generic[T]", "enum.Enum", "metaclass=ABCMeta", "", " a.b [x.y]", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(bases)], "i int, x string").orderBy("i").select(columns.base_name(F.col("x"))).collect()]
    assert got == ["Generic", "Enum", "", "", "b", None]


def test_find_ranks_qualified_names(spark):
    rows = [("run", "Job.run", "method", "a.py", 1), ("job_run", "job_run", "function", "a.py", 9), ("Job", "Job", "class", "b.py", 1), ("runs", "runs", "function", "c.py", 1)]
    s = spark.createDataFrame(rows, "name string, qualname string, kind string, path string, line int")
    assert [(r["rank"], r["name"]) for r in refs.find(s, "job.run").orderBy("rank", "name").collect()] == [(1, "run")]
    assert [(r["rank"], r["name"]) for r in refs.find(s, "run").orderBy("rank", "name").collect()] == [(0, "run"), (2, "runs"), (3, "job_run")]
    assert [r["name"] for r in refs.find(s, "run", kind="method").collect()] == ["run"]


def test_scopes(spark):
    paths = spark.createDataFrame([("pkg/__init__.py",), ("pkg/a.py",), ("pkg/sub/b.py",), ("main.py",)], "path string")
    statements = spark.createDataFrame([("main.py", "pkg", 0, ["a", "missing"]), ("main.py", "pkg.a", 0, []), ("pkg/sub/b.py", "", 2, ["a"])], "importer string, module string, level int, names array<string>")
    got = {tuple(r) for r in resolve.import_scopes(statements, paths).select("path", "binding", "kind", "target").collect()}
    assert {("main.py", "a", "module", "pkg/a.py"), ("main.py", "pkg", "file", "pkg/__init__.py"), ("main.py", "pkg.a", "file", "pkg/a.py"), ("pkg/sub/b.py", "a", "module", "pkg/a.py")} <= got
    assert not [g for g in got if g[1] == "missing"]
    symbols = spark.createDataFrame([("pkg/a.py", "f"), ("main.py", "f")], "path string, name string")
    uses = spark.createDataFrame([("main.py", "a", "f"), ("main.py", "os", "f")], "path string, qualifier string, name string")
    bound = resolve.import_scopes(statements, paths).where("kind = 'module'")
    assert [tuple(r) for r in resolve.module_attributes(uses, bound, symbols).collect()] == [("main.py", "a", "f", "pkg/a.py")]


def test_listings(spark):
    members = spark.createDataFrame([(f"n{i:03d}", "big" if i % 3 else f"c{i}") for i in range(90)], "node string, community string")
    rows = graph.listed_communities(members, shown=3, limit=4).orderBy("place").collect()
    assert [(r["community"], r["size"], r["members"]) for r in rows] == [("big", 60, "n001,n002,n004"), ("c0", 1, "n000"), ("c3", 1, "n003"), ("c6", 1, "n006")]
    cycles = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")], "node string, component string")
    assert [(r["length"], r["files"]) for r in graph.listed_cycles(cycles).orderBy("place").collect()] == [(2, "a,b"), (3, "c,d,e")]
    heads = packing.sticky_headers(spark.createDataFrame([("p", 5), ("p", 8), ("p", 200)], "path string, start int"), spark.createDataFrame([("p", 1, None), ("p", 6, 9), ("p", 8, 9)], "path string, line int, end_line int"))
    assert sorted(map(tuple, heads.collect())) == [("p", 5, 1), ("p", 8, 6)]


def test_body_keys_feed_the_lint(spark):
    body = "\n".join(["one two three four", "  five six seven eight", "nine ten eleven twelve"])
    files = spark.createDataFrame([("a", "def f\n" + body), ("b", "def g\n" + body.replace("  ", "\t") + "\nlast"), ("c", "def h\nshort")], "path string, text string")
    s = spark.createDataFrame([("a", "f", 1, None), ("b", "g", 1, 4), ("c", "h", 1, 2)], "path string, name string, line int, end_line int")
    keys = {r["path"]: r["body_key"] for r in refs.body_keys(s, files).collect()}
    assert keys["a"] and keys["a"] == keys["b"] and keys["c"] is None


def test_drift(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, text string")
    got = index.drift(f([("a", "x\ny"), ("b", "x"), ("c", "x")]), f([("a", "x\nz"), ("b", "x\nmore"), ("c", "x")]))
    assert sorted(map(tuple, got.collect())) == [("a", 2, "y", "z"), ("b", 2, None, "more")]
    assert render.first_difference("a\nb\n", "```mermaid\na\nb\n```\n") is None
    assert render.first_difference("a\nb", "a\nc") == (2, "b", "c") and render.first_difference("a", "a\nb") == (2, None, "b")
    assert render.receipt("r", head="h", dirty=False) == {"repository": "r", "head": "h", "dirty": "no"}


def test_generations(spark, tmp_path):
    root, df = f"file://{tmp_path}/index", spark.range(3)
    assert store.current(spark, root) is None
    store.publish({"t": df}, root, "one")
    old = store.table(spark, root, "t")
    store.publish({"t": df.union(df)}, root, "two")
    assert store.current(spark, root) == "two" and store.table(spark, root, "t").count() == 6 and old.count() == 3
    with store.writing(spark, root), pytest.raises(store.Busy):
        store.publish({"t": df}, root, "three")
    store.publish({"t": df}, root, "one")
    assert store.current(spark, root) == "one" and old.count() == 3


def test_files_appear_whole_or_not_at_all(tmp_path):
    (tmp_path / "a.txt").write_text("old")
    store.write_all(tmp_path, {"a.txt": "new", "d/b.txt": "b"})
    assert (tmp_path / "a.txt").read_text() == "new" and (tmp_path / "d/b.txt").read_text() == "b"
    (tmp_path / "block").mkdir()
    with pytest.raises(OSError):
        store.write_all(tmp_path, {"a.txt": "newer", "e/c.txt": "c", "block": "x"})
    assert (tmp_path / "a.txt").read_text() == "new" and sorted(p.name for p in tmp_path.iterdir()) == ["a.txt", "block", "d"]
    with pytest.raises(ValueError):
        store.write_all(tmp_path, {"../out.txt": "x"})
    assert store.write_page(tmp_path, "g.html", "<p>").read_text() == "<p>"
    for bad in ("../g.html", "g.txt", ".html", "d/g.html"):
        with pytest.raises(ValueError):
            store.write_page(tmp_path, bad, "")
