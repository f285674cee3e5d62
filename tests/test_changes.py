import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.operators import edits, graph, lint, packing, refs, render, vote
from codeloom.sources import patches

BLOCKS = """Some words.
### src/a.py
```python
<<<<<<< SEARCH
x = 1
=======
x = 2
>>>>>>> REPLACE
```
<<<<<<< SEARCH
y = 1
=======
y = 2
>>>>>>> REPLACE
src/b c.py
<<<<<<< SEARCH
z
=======
>>>>>>> REPLACE
"""


def test_blocks():
    assert [(b["path"], b["search"], b["replace"]) for b in patches.blocks(BLOCKS)] == [("src/a.py", "x = 1", "x = 2"), ("src/a.py", "y = 1", "y = 2"), ("src/b c.py", "z", "")]
    for bad in ("", "nothing", "a.py\n<<<<<<< SEARCH\nx\n", "a.py\n<<<<<<< SEARCH\nx\n>>>>>>> REPLACE\n", "<<<<<<< SEARCH\nx\n=======\ny\n>>>>>>> REPLACE", "a.py\n<<<<<<< SEARCH x\n=======\n>>>>>>> REPLACE", "*** Begin Patch"):
        assert all(b["error"] for b in patches.blocks(bad)), bad


def test_unified():
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n@@ -9 +9,2 @@\n k\n+l\n"
    assert [(b["path"], b["search"], b["replace"]) for b in patches.unified(text)] == [("x.py", "a\nb\nc", "a\nB\nc"), ("x.py", "k", "k\nl")]
    assert patches.unified("rename from a\nrename to b\n")[0]["error"] and patches.unified("")[0]["error"]
    assert patches.unified("--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n")[0]["error"]


def test_json_and_choice():
    assert patches.any_edits('{"edits": [{"path": "a", "search": "s", "replace": "r"}]}')[0]["replace"] == "r"
    assert patches.any_edits('{"edits": 3}')[0]["error"] and patches.any_edits(BLOCKS)[1]["search"] == "y = 1"


def test_apply(spark):
    files = spark.createDataFrame([("src/a.py", "x = 1\ny = 1\nx = 10\n", None), ("b.py", "q\nq\nr", None), ("c.py", "m\nn\nm\nn", [[3, -1]])], "path string, text string, spans array<array<int>>")
    rows = [("k", 0, "src/a.py", "x = 1", "x = 2\nw", None), ("k", 1, "src/a.py", "y = 1", "y = 2", None), ("k", 2, "b.py", "q", "z", None), ("k", 3, "b.py", "nope", "z", None), ("k", 4, "no.py", "a", "b", None), ("k", 5, "c.py", "m", "M", None), ("l", 0, "c.py", "m\nn\nm", "M", None)]
    df = spark.createDataFrame(rows, patches.EDITS)
    got = {(r.candidate, r.path, r["at"]): r for r in edits.apply_edits(df, files).collect()}
    assert [got[("k", "src/a.py", i)].status for i in (0, 1)] == ["applied", "applied"]
    assert got[("k", "src/a.py", 1)].text == "x = 2\nw\ny = 2\nx = 10\n"
    assert (got[("k", "b.py", 2)].status, got[("k", "b.py", 2)].matches, got[("k", "b.py", 3)].status) == ("ambiguous", 2, "not_found")
    assert got[("k", "no.py", 4)].status == "no_such_file" and got[("k", "c.py", 5)].text == "m\nn\nM\nn" and got[("l", "c.py", 0)].status == "outside_intervals"
    facing = {(r.candidate, r["at"]): r.facing for r in edits.oriented(df, files).collect()}
    assert facing[("k", 0)] == "forward" and facing[("k", 4)] == "no_such_file"


def test_change_keys(spark):
    rows = [("a", "p", "python", "x=1\n", "x = 2\n"), ("b", "p", "python", "x=1\n", "x  =  2 # c\n"), ("c", "p", "python", "x=1\n", "x = 3\n"), ("d", "p", "python", "x=1\n", "x = 1\n"), ("e", "p", "text", "a", "a  b")]
    got = {r.candidate: r for r in edits.change_keys(spark.createDataFrame(rows, "candidate string, path string, lang string, old string, new string")).collect()}
    assert got["a"].key == got["b"].key != got["c"].key and got["d"].key == hashlib.sha256(b"").hexdigest() and got["a"].parses


def test_lint(spark):
    tree = spark.createDataFrame([("m.py", "alpha_beta", "", "function", [], 1, 2, "k1"), ("n.py", "gamma", "", "function", [], 0, 0, "k2")], "path string, name string, parent string, kind string, decorators array<string>, required int, total int, body_key string")
    added = spark.createDataFrame([("c", "new.py", "gamma", "", "function", [], 0, 0, "k1", 3)], "candidate string, path string, name string, parent string, kind string, decorators array<string>, required int, total int, body_key string, line int")
    removed = spark.createDataFrame([("c", "m.py", "alpha_beta")], "candidate string, path string, name string")
    used = spark.createDataFrame([("c", "new.py", "len", 1), ("c", "new.py", "gama", 2), ("c", "new.py", "own", 3)], "candidate string, path string, name string, line int")
    bound = spark.createDataFrame([("c", "own")], "candidate string, name string")
    imported = spark.createDataFrame([("c", "new.py", "os.path", 0, 1), ("c", "new.py", "Left_Pad", 0, 2), ("c", "new.py", "m", 0, 3), ("c", "new.py", "strange.thing", 0, 4)], "candidate string, path string, module string, level int, line int")
    none = spark.createDataFrame([], "module string, level int")
    files = spark.createDataFrame([("m.py",), ("n.py",)], "path string")
    sites = spark.createDataFrame([("n.py", "alpha_beta", 7), ("n.py", "alpha_beta", 9), ("new.py", "alpha_beta", 1)], "path string, name string, line int")
    calls = spark.createDataFrame([("c", "n.py", "alpha_beta", 4, 3), ("c", "n.py", "alpha_beta", 5, 2), ("c", "n.py", "alpha_beta", 6, None)], "candidate string, path string, name string, line int, arguments int")
    out = lint.report(
        lint.undeclared_imports(imported, spark.createDataFrame([("left-pad",)], "name string"), none, files),
        lint.shadowing(added, removed, tree),
        lint.near_duplicates(added, removed.limit(0), tree),
        lint.dangling_references(used, added, removed, tree, bound),
        lint.dangling_callers(removed, added, tree, sites, added.select("candidate", "path").union(removed.select("candidate", "path"))),
        lint.arity(calls, tree, added),
        lint.new_cycles(spark.createDataFrame([("a", "a"), ("a", "b")], "component string, node string"), spark.createDataFrame([("c", "a", "b"), ("c", "a", "a"), ("c", "x", "x"), ("c", "x", "y")], "candidate string, component string, node string")),
        lint.not_checked(spark.createDataFrame([("c", "bad.py", "SyntaxError")], "candidate string, path string, reason string"), "arity"),
    ).orderBy("place").collect()
    assert [(r.check, r.severity, r.line, r.evidence) for r in out] == [
        ("arity", "not_checked", None, "SyntaxError"),
        ("arity", "warning", 4, "takes 1 to 2"),
        ("cycle_delta", "warning", None, "x,y"),
        ("dangling_callers", "warning", None, "n.py:7, n.py:9"),
        ("dangling_references", "warning", 2, "did you mean gamma"),
        ("near_duplicates", "advisory", 3, "m.py::alpha_beta"),
        ("shadowing", "advisory", 3, "n.py"),
        ("undeclared_imports", "warning", 4, "strange.thing"),
    ]


def test_vote_ladder(spark):
    schema = "run int, id string, index int, key string, applied boolean, measured boolean, regression_passed boolean, reproduction_passed boolean"
    rows = [(1, "a", 0, "k", True, True, True, False), (1, "b", 1, "k", True, True, True, False), (1, "c", 2, None, True, True, True, False), (1, "d", 3, "k", False, True, True, True), (2, "e", 0, "k", True, True, False, True), (2, "f", 1, "k", True, True, True, True), (3, "g", 0, "k", True, False, True, True)]
    df = spark.createDataFrame(rows, schema)
    got = [(r.run, r.rung, r.place, r.key, r.size, r.representative, r.members) for r in vote.clusters(vote.ladder(df)).orderBy("run", "place").collect()]
    assert got == [(1, "regression", 1, "k", 2, "a", "a,b"), (1, "regression", 2, None, 1, "c", "c"), (2, "reproduction_and_regression", 1, "k", 1, "f", "f")]
    assert vote.ladder(df, reproduction_valid=False).where("run = 2").first().rung == "regression"


def plain_fair(costs, budget):
    left, need = budget, dict(costs)
    out = {}
    while need:
        share = left // len(need)
        small = {k: c for k, c in need.items() if c <= share}
        if not small:
            return out | dict.fromkeys(need, max(share, 0))
        for k, c in small.items():
            out[k] = c
            left -= c
            del need[k]
    return out


def test_packing(spark):
    import random

    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 50)) for g in range(12) for i in range(rng.randint(1, 15))]
    got = packing.fair_shares(spark.createDataFrame(rows, "g int, i int, cost int"), ["g"], "i", "cost", 200).collect()
    for g in range(12):
        mine = {i: c for h, i, c in rows if h == g}
        assert {r.i: r.granted for r in got if r.g == g} == plain_fair(mine, 200)
    spans = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 6, 7), ("a", 2, 2), ("b", 5, 4)], "p string, start int, end int")
    assert sorted((r.p, r.start, r.end) for r in packing.merge_intervals(spans, ["p"]).collect()) == [("a", 1, 5), ("a", 6, 7)]
    paths = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string")
    assert [r.line for r in packing.tree(paths, 2).orderBy("place").collect()] == ["a/", "    b/ ...", "    d.py", "e.py"]


def test_graph_closed_forms(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    for small in (0, 100):
        one = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
        got = {r.node: r.rank for r in graph.pagerank(nodes, one, epsilon=1e-6, small=small).collect()}
        assert got["a"] == pytest.approx(0.35087719, abs=1e-5) and sum(got.values()) == pytest.approx(1)
        seeds = spark.createDataFrame([("b", 2.0), ("unknown", 9.0)], "node string, weight double")
        got = {r.node: r.rank for r in graph.pagerank(nodes, one, seeds, small=small).collect()}
        assert got["b"] == pytest.approx(1, abs=1e-4)
    cliques = [(x, y, 5.0) for c in ("abc", "xyz") for x in c for y in c if x != y] + [("c", "x", 1.0)]
    edges = spark.createDataFrame(cliques, "src string, dst string, weight double")
    member = graph.communities(edges)
    assert sorted((r.node, r.community) for r in member.collect()) == [(n, "a") for n in "abc"] + [(n, "x") for n in "xyz"]
    assert [(r.internal, r.total) for r in graph.partition_score(edges, member).orderBy("community").collect()] == [(60.0, 61.0)] * 2
    path = graph.shortest_path(edges, "a", "z").orderBy("step").collect()
    assert [r.node for r in path] == ["a", "c", "x", "z"] and path[2].forward
    assert graph.shortest_path(edges, "a", "q").count() == 0
    cyc = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f")], "src string, dst string")
    assert sorted((r.node, r.component) for r in graph.cycle_groups(cyc).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")]
    with pytest.raises(ValueError):
        graph.check_graph(nodes, spark.createDataFrame([("a", "z")], "src string, dst string"))


def test_near_names(spark):
    known = spark.createDataFrame([(x,) for x in ("alpha", "alpah", "alp_ha", "beta", "alphabet")], "name string")
    got = [(r.near, r.distance) for r in refs.near_names(spark.createDataFrame([("Alpha",)], "name string"), known).orderBy("distance", "near").collect()]
    assert got == [("alp_ha", 0), ("alpha", 0), ("alpah", 2)]


def test_render():
    assert render.safe_label("a<b>>c" + "x" * 80).startswith("a_b_c") and len(render.safe_label("x" * 99)) == 60
    assert render.map_text([{"path": "a.py", "rank": 0.5, "symbols": [{"line": 3, "signature": "def f()"}], "omitted": 2}]) == "a.py  (rank 0.5000)\n    3 def f()\n      ... 2 more"
    assert render.numbered("a\nb\nc\nd", [(2, 3)]) == "...\n    2 b\n    3 c\n..."
    chart = render.flowchart([{"src": "a", "dst": "b", "kind": "import"}, {"src": "b", "dst": "c", "kind": "reference"}], {"a": "G"}, 4)
    assert "n0 --> n1" in chart and "n1 -.-> n2" in chart and 'subgraph g1["G"]' in chart and "4 more nodes" in chart
    assert "</script><" not in render.page([{"src": "</script>", "dst": "b", "kind": "x", "weight": 1}], "t").replace("</script>", "", 0).split("json")[1][:-10]
    assert render.envelope({"repo": "r"}, "x" * 10 + "\n" + "y" * 100, 5).endswith("[cut: 1 more lines]")
    with pytest.raises(ValueError):
        render.json_envelope({}, {"receipt": 1}, "rows")
    assert '"truncated": true' in render.json_envelope({}, {"rows": ["x" * 30] * 9}, "rows", 40)


def test_streaming(spark, tmp_path):
    from codeloom.streaming.changes import keep_index

    src = str(tmp_path / "in")
    rows = [("a/x", "1"), ("a/x", "1"), ("a/x", "2"), ("a/y", "1")]
    spark.createDataFrame([(p, t) for p, t in rows], "path string, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("path string, text string, ts timestamp").parquet(src)
    got = []
    q = keep_index(stream, lambda df, n: got.extend((r.path, r.text) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == [("a/x", "1"), ("a/x", "2"), ("a/y", "1")]


def test_edits_are_dealt_and_applied_without_a_python_group_each(spark):
    texts = spark.createDataFrame([(f"c{i}", f"f{i}.py\n<<<<<<< SEARCH\nx = {i}\n=======\ny\n>>>>>>> REPLACE\n") for i in range(60)], "candidate string, text string").coalesce(1)
    parsed = patches.parse(texts)
    assert parsed.rdd.getNumPartitions() > 1 and parsed.where("error is null").count() == 60
    files = spark.createDataFrame([(f"f{i}.py", f"a\nx = {i}") for i in range(60)], "path string, text string")
    out = edits.apply_edits(parsed, files)
    assert {r.text for r in out.collect()} == {"a\ny"} and "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_near_duplicates_by_brute_force_and_with_one_key(spark):
    import random

    rng = random.Random(5)
    pick = lambda: (rng.choice("pqr"), rng.choice("abcd"))
    tree = [(*pick(), rng.choice(["k", "l", None])) for _ in range(20)]
    added = [(rng.choice("cd"), *pick(), i, rng.choice(["k", "l", "m", None])) for i in range(200)]
    removed = [(rng.choice("cd"), *pick()) for _ in range(12)]
    df = lambda rows, schema: spark.createDataFrame(rows, ", ".join(f"{c} string" if c != "line" else "line int" for c in schema.split()))
    got = lint.near_duplicates(df(added, "candidate path name line body_key"), df(removed, "candidate path name"), df(tree, "path name body_key")).collect()
    want = {}
    for c, p, n, i, k in added:
        same = [f"{q}::{m}" for q, m, j in tree if j is not None and j == k and (q, m) != (p, n) and (c, q, m) not in removed]
        if same:
            want[i] = min(same)
    assert {r.line: r.evidence for r in got} == want and 0 < len(want) < 150
    # 4e9 pairs of one key, so that making them would not end
    many = spark.range(200_000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("n").alias("name"), F.lit("k").alias("body_key"))
    some = spark.range(20_000).select(F.lit("c").alias("candidate"), F.lit("new").alias("path"), F.lit("n").alias("name"), F.col("id").cast("int").alias("line"), F.lit("k").alias("body_key"))
    gone = many.limit(0).select(F.lit("c").alias("candidate"), "path", "name").union(df([("c", "p0", "n")], "candidate path name"))
    assert [tuple(r) for r in lint.near_duplicates(some, gone, many).groupBy("evidence").count().collect()] == [("p100000::n", 20_000)]
