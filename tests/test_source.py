import textwrap

import pytest

from codeloom.functions import other_source as o
from codeloom.functions import python_source as p
from codeloom.sources import code

SHOP = textwrap.dedent('''
    """Prices."""
    import os.path as osp
    import math
    from .base import Base, helper as h
    from enum import Enum

    MAX_ITEMS = 3  # NOTE: agreed in ADR-7
    type Money = int


    class Colour(Enum):
        """The colours."""
        RED = 1


    @dataclass(frozen=True)
    class Item(Base):
        """An item.

        More.
        """

        price: int = 0

        def total(self, n, rate=1.0):
            """Price with tax."""
            # WHY: see RFC 12
            amount = self.price * n
            return math.floor(amount * rate) + MAX_ITEMS

        async def load(self): return await h(self)


    def free(a, *rest, key=None):
        global counter
        counter = [x for x in rest if x > a]
        return Item(price=len(counter))
''').lstrip()


def test_python_symbols():
    got = [(s["name"], s["kind"], s["parent"], s["is_async"]) for s in p.symbols(SHOP)]
    assert got == [("MAX_ITEMS", "constant", "", False), ("Money", "type_alias", "", False), ("Colour", "enum", "", False), ("Item", "dataclass", "", False), ("total", "method", "Item", False), ("load", "method", "Item", True), ("free", "function", "", False)]
    item = p.symbols(SHOP)[3]
    assert (item["docstring"], item["bases"], item["decorators"]) == ("An item.", ["Base"], ["dataclass(frozen=True)"])
    assert p.class_kind(["typing.Protocol[T]"], []) == "protocol" and p.class_kind([], []) == "class"


def test_python_imports():
    assert [(i["module"], i["names"], i["level"]) for i in p.imports(SHOP)] == [("os.path", [], 0), ("math", [], 0), ("base", ["Base", "helper"], 1), ("enum", ["Enum"], 0)]


def test_python_roles():
    roles = {(r["name"], r["role"], r["qualifier"]) for r in p.references(SHOP)}
    assert ("floor", "module_attribute", "math") in roles and ("math", "module_qualifier", "") in roles
    assert ("amount", "binding", "") in roles and ("amount", "local", "") in roles
    assert ("counter", "reference", "") in roles and ("counter", "binding", "") not in roles  # global
    assert ("price", "attribute", "") in roles and ("price", "keyword", "") in roles
    assert ("MAX_ITEMS", "reference", "") in roles and ("Base", "reference", "") in roles and ("total", "declaration", "") in roles
    inside = {(r["name"], r["role"]) for r in p.references("class A:\n    x = 1\n    y = x\n    def f(self):\n        return x\n")}
    assert ("x", "local") in inside and ("x", "reference") in inside  # class scope is not seen from inside its functions


def test_rationales_attach_to_the_innermost_symbol():
    notes = p.rationales(SHOP)
    assert [(n["kind"], n["citations"]) for n in notes] == [("note", ["ADR-7"]), ("why", ["RFC 12"])]
    symbols = p.symbols(SHOP)
    assert [symbols[at]["name"] for _, at in p.attach(symbols, notes)] == ["MAX_ITEMS", "total"]


def test_shapes_and_calls():
    assert p.parameters("def f(self, a, b=1)") == {"required": 1, "total": 2}
    assert p.parameters("def f(a, *rest, key=None)") == {"required": 1, "total": None}
    assert [(c["name"], c["arguments"]) for c in p.call_sites("f(1, 2)\ng(*a)\nx.h(1)\n")] == [("f", 2), ("g", None)]


def test_skeleton():
    text = p.skeleton(SHOP, docstrings=True)
    assert "amount" not in text and "WHY" not in text and "def total(self, n, rate=1.0):\n        \"\"\"Price with tax.\"\"\"\n        ..." in text
    assert '"""An item."""' in text and "More." not in text and "\n\n\n" not in text
    assert len(SHOP) > len(p.skeleton(SHOP))
    assert p.skeleton("def f():\n    def g():\n        pass\n    return g\n") == "def f():\n    ..."
    assert p.skeleton("x = 1\n", numbers=True) == "    1 x = 1"


def test_stream_ignores_layout_and_comments_but_not_code():
    a, b = "def f(x):\n    # hi\n    return x+1\n", "def f( x ):\n\n        return x + 1\n"
    assert p.stream(a) == p.stream(b) != p.stream(a.replace("+", "-"))
    assert "noqa" in p.stream("x = 1  # noqa\n") and p.parses("x") and not p.parses("x =")


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("typescript", "export class Shop extends Base {\n  total(n: number): number {\n  }\n}\nexport interface Item {}\nconst add = (a, b) => a + b\nfunction go() {}\n", {("Shop", "class", ""), ("total", "method", "Shop"), ("Item", "protocol", ""), ("add", "function", ""), ("go", "function", "")}),
        ("go", "func (s *Shop) Total(n int) int {\n}\nfunc New() *Shop {\n}\n", {("Total", "method", "Shop"), ("New", "function", "")}),
        ("rust", "pub struct Shop;\nimpl Base for Shop {\n    pub fn total(&self) -> u32 {\n    }\n}\nfn free() {}\nenum E { A }\n", {("Shop", "class", ""), ("total", "method", "Shop"), ("free", "function", ""), ("E", "enum", "")}),
        ("java", "public class Shop {\n    public int total(int n) {\n    }\n}\n", {("Shop", "class", ""), ("total", "method", "Shop")}),
        ("ruby", "class Shop\n  def total(n)\n  end\nend\n", {("Shop", "class", ""), ("total", "method", "Shop")}),
        ("lua", "local M = {}\nfunction M.go(a)\nend\nMAX = 3\n", {("M", "class", ""), ("go", "method", "M"), ("MAX", "constant", "")}),
        ("sql", "CREATE TABLE item (\n  id int,\n  name text\n);\nCREATE VIEW v AS SELECT 1;\n", {("item", "class", ""), ("id", "constant", "item"), ("name", "constant", "item"), ("v", "type_alias", "")}),
        ("toml", "[tool.x]\nname = 1\n", {("tool.x", "class", ""), ("name", "constant", "tool.x")}),
        ("yaml", "a:\n  b: 1\nc: 2\n", {("a", "class", ""), ("b", "constant", "a"), ("c", "constant", "")}),
        ("json", '{"a": {"b": 1}, "c": 2}', {("a", "class", ""), ("b", "constant", "a"), ("c", "constant", "")}),
        ("hcl", 'resource "t" "main" {\n  size = 3\n}\n', {("main", "class", ""), ("size", "constant", "main")}),
        ("bash", "go() {\n  echo\n}\n", {("go", "function", "")}),
        ("c", "struct item {\n};\nint total(int n) {\n}\n", {("item", "class", ""), ("total", "function", "")}),
    ],
)
def test_other_languages(lang, text, want):
    assert {(s["name"], s["kind"], s["parent"]) for s in o.symbols(text, lang)} == want


def test_other_imports():
    assert [(i["module"], i["is_relative"]) for i in o.imports("import {a} from './b'\nconst c = require('d')\n", "typescript")] == [("./b", True), ("d", False)]
    assert [(i["module"], i["is_relative"]) for i in o.imports('#include "a.h"\n#include <b.h>\n', "c")] == [("a.h", True), ("b.h", False)]
    assert [i["module"] for i in o.imports("use crate::a::b;\n", "rust")] == ["crate::a::b"]
    assert dict(o.capabilities())["python"] == "parser"


def test_a_tree_becomes_facts(spark, tmp_path):
    for name, text in {"shop/item.py": SHOP, "shop/base.py": "class Base: pass\ndef helper(x): return x\n", "bad.py": "def (", "a.ts": "export class A {}\n", "readme.txt": "hello"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = code.with_language(code.scan(spark, str(tmp_path)))
    assert sorted((r.path, r.lang) for r in files.collect()) == [("a.ts", "typescript"), ("bad.py", "python"), ("shop/base.py", "python"), ("shop/item.py", "python")]
    facts = code.extract(files).cache()
    assert [(r.path, r.reason[:11]) for r in code.skipped(facts).collect()] == [("bad.py", "SyntaxError")]
    assert {r.name for r in code.symbols(facts).where("path = 'shop/base.py'").collect()} == {"Base", "helper"}
    from codeloom.operators.resolve import import_targets

    got = import_targets(code.imports(facts), files)
    assert [(r.importer, r.target) for r in got.collect()] == [("shop/item.py", "shop/base.py")]
    with pytest.raises(ValueError):
        code.scan(spark, str(tmp_path), max_files=2)


def test_small_texts_of_one_split_are_dealt_and_parsed_once(spark, monkeypatch):
    files = spark.createDataFrame([(f"m{i}.py", "python", f"import os\nN_{i} = {i}\n" if i % 5 else "def (") for i in range(50)], "path string, lang string, text string").coalesce(1)
    facts = code.extract(files, ["import"])
    assert facts.rdd.getNumPartitions() > 1
    assert {(r.fact, r.module) for r in facts.collect()} == {("import", "os")} and facts.count() == 40
    assert sorted(r.path for r in code.skipped(code.extract(files, ["skipped"])).collect()) == sorted(f"m{i}.py" for i in range(0, 50, 5))
    parsed, real = [], p.ast.parse
    monkeypatch.setattr(p.ast, "parse", lambda text: parsed.append(text) or real(text))
    assert code._facts("shop.py", "python", SHOP) and len(parsed) == 1
