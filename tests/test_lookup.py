import pytest

from codeloom.operators import lookup
from codeloom.sources import project


def test_focus_takes_the_first_way_that_fits(spark):
    files = spark.createDataFrame([("app/envelope.py",), ("lib/config.go",), ("config/config.go",), ("x.py",)], "path string")
    symbols = spark.createDataFrame([("x.py", "Validate", "Server"), ("lib/config.go", "Validate", ""), ("x.py", "envelope", ""), ("app/envelope.py", "only", "")], "path string, name string, parent string")
    entries = spark.createDataFrame([("x.py",), ("config.go",), ("envelope",), ("Server.Validate",), ("Validate",), ("no/such.py",), ("py:x.py::Server.Validate",), ("only",)], "entry string")
    got = {}
    for r in lookup.focus(entries, files, symbols).collect():
        got.setdefault(r.entry, []).append((r.path, r.how))
    assert {k: sorted(v) for k, v in got.items()} == {
        "x.py": [("x.py", "path")],
        "config.go": [("config/config.go", "suffix"), ("lib/config.go", "suffix")],
        "envelope": [("app/envelope.py", "stem")],
        "Server.Validate": [("x.py", "qualified")],
        "Validate": [("lib/config.go", "qualified")],
        "only": [("app/envelope.py", "qualified")],
        "py:x.py::Server.Validate": [("x.py", "qualified")],
    }
    seeds = {r.node: r.weight for r in lookup.seeds(lookup.focus(entries, files, symbols)).collect()}
    assert seeds["config/config.go"] == 0.5 and seeds["x.py"] == 3.0


def test_definitions_and_limits(spark):
    symbols = spark.createDataFrame([("a.py", "f", 3), ("b.py", "f", 1)], "path string, name string, line int")
    targets = spark.createDataFrame([("py:a.py::f",), ("f",), ("py:gone.py::f",)], "target string")
    got = sorted((r.target, r.path, r.place) for r in lookup.definitions(targets, symbols).collect())
    assert got == [("f", "a.py", 1), ("f", "b.py", 2), ("py:a.py::f", "a.py", 1), ("py:gone.py::f", "a.py", 1), ("py:gone.py::f", "b.py", 2)]
    assert [r.answered for r in lookup.within_limit(targets, "target", 2).orderBy("place").collect()] == [True, True, False]


def test_locations(spark):
    rows = [("a.py", "A", "class", "", 1, 9, 0), ("a.py", "go", "method", "A", 2, 3, 0), ("a.py", "go", "method", "A", 4, 5, 1), ("a.py", "run", "method", "A", 6, 7, 0), ("a.py", "run", "method", "B", 12, 13, 0), ("a.py", "B", "class", "", 11, 14, 0), ("a.py", "MAX", "constant", "", 20, None, 0), ("a.py", "free", "function", "", 22, 24, 0)]
    symbols = spark.createDataFrame(rows, "path string, name string, kind string, parent string, line int, end_line int, ordinal int")
    lines = spark.createDataFrame([("a.py", 30)], "path string, total int")
    asked = ["function: run", "class: A", "function: run", "A.go#2", "function: free", "variable: MAX", "line: 7 in A", "line: 99", "class: Z", "what", "A.nope", "A.go#3"]
    locs = spark.createDataFrame([("a.py", i, x) for i, x in enumerate(asked)], "path string, ord int, loc string")
    got = [(r.start, r.end, r.reason) for r in lookup.locations(locs, symbols, lines).orderBy("ord").collect()]
    assert got == [(None, None, "ambiguous"), (1, 9, None), (6, 7, None), (4, 5, None), (22, 24, None), (20, 20, None), (7, 7, None), (None, None, "no such line"), (None, None, "no such symbol"), (None, None, "unknown location form"), (None, None, "no such symbol"), (None, None, "no such ordinal")]


def test_project(tmp_path):
    s = project.settings('{"map_budget": 500, "max_files": 0, "stoplist": ["a", "b c"], "odd": 1}')
    assert s.map_budget == 500 and s.max_files is None and s.stoplist == {"a"} and len(s.warnings) == 3
    assert project.settings("[1]").warnings and project.settings("{").warnings
    assert project.declared('[project]\ndependencies = ["A_b>=1"]\n[project.optional-dependencies]\nx = ["c.d[e]"]\n') == ["a-b", "c-d"]
    with pytest.raises(ValueError):
        project.contained(str(tmp_path), "../x")
    assert project.contained(str(tmp_path), "a/b").name == "b" and project.state(str(tmp_path))["note"]
    with pytest.raises(PermissionError):
        project.allowed(str(tmp_path / "x"), [str(tmp_path)])
    assert project.intervals([[1, 3], [4, -1]]) == [(1, 3), (4, -1)]
    with pytest.raises(ValueError):
        project.intervals([[3, 1]])
