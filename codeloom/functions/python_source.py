"""Facts of Python sources, from the standard library's parser. Plain functions over one text; they run inside Spark tasks.

A text that does not parse raises SyntaxError; callers turn that into a skipped file with a reason.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

_CONSTANT = re.compile(r"[A-Z_][A-Z0-9_]*$")
#: Comment words that mark a rationale.
_RATIONALE = re.compile(r"\b(NOTE|WHY|HACK|TODO)\s*:\s*(.*)")
_CITATION = re.compile(r"(?i)\b(?:ADR|RFC)[\s-]*\d+")
MAX_SIGNATURE, MAX_RATIONALE, MAX_DOCSTRING = 80, 240, 200


def _one_line(text: str, most: int = MAX_SIGNATURE) -> str:
    text = " ".join(text.split())
    return text if len(text) <= most else text[: most - 3] + "..."


def class_kind(bases: list[str], decorators: list[str]) -> str:
    """dataclass by decorator, then protocol and enum by a base's name, else class."""
    if any("dataclass" in d for d in decorators):
        return "dataclass"
    for word, kind in (("Protocol", "protocol"), ("Enum", "enum")):
        if any(word in b for b in bases):
            return kind
    return "class"


def _symbol(node: ast.AST, name: str, kind: str, parent: str = "", signature: str = "", **more) -> dict:
    return {
        "name": name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno, "signature": _one_line(signature or name), "parent": parent,
        "docstring": "", "decorators": [], "bases": [], "is_public": not name.startswith("_"), "is_async": False,
    } | more


def _defined(node: ast.AST, parent: str) -> Iterator[dict]:
    decorators = [ast.unparse(d) for d in getattr(node, "decorator_list", [])]
    doc = (ast.get_docstring(node) or "").strip().split("\n")[0] if not isinstance(node, ast.Assign) else ""
    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        is_async = isinstance(node, ast.AsyncFunctionDef)
        text = f"{'async ' * is_async}def {node.name}({ast.unparse(node.args)}){back}"
        yield _symbol(node, node.name, "method" if parent else "function", parent, text, docstring=doc, decorators=decorators, is_async=is_async)
    elif isinstance(node, ast.ClassDef):
        bases = [ast.unparse(b) for b in [*node.bases, *node.keywords]]
        text = f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"
        yield _symbol(node, node.name, class_kind(bases, decorators), parent, text, docstring=doc, decorators=decorators, bases=bases)
        for x in node.body:
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                yield from _defined(x, node.name)


def tree(text: str | ast.Module) -> ast.Module:
    """The text parsed; a tree is taken as it is, so that several kinds of facts share one."""
    return text if isinstance(text, ast.Module) else ast.parse(text)


def symbols(text: str | ast.Module) -> list[dict]:
    """Top-level functions, classes with their own methods, upper-case constants and type aliases, in source order."""
    out: list[dict] = []
    for node in tree(text).body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out += _defined(node, "")
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            out += [_symbol(node, t.id, "constant", "", ast.unparse(node)) for t in targets if isinstance(t, ast.Name) and _CONSTANT.match(t.id)]
        elif isinstance(node, ast.TypeAlias):
            out.append(_symbol(node, node.name.id, "type_alias", "", ast.unparse(node)))
    return out


def imports(text: str | ast.Module) -> list[dict]:
    """Module-level imports; a plain import names nothing, an alias gives way to the imported name."""
    out = []
    for node in tree(text).body:
        if isinstance(node, ast.Import):
            out += [{"module": a.name, "names": [], "is_relative": False, "level": 0, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append({"module": node.module or "", "names": [a.name for a in node.names], "is_relative": node.level > 0, "level": node.level, "line": node.lineno})
    return out


class _Scope:
    def __init__(self, above: _Scope | None, kind: str) -> None:
        self.above, self.kind, self.bound, self.open = above, kind, set(), set()

    def holds(self, name: str) -> bool:
        """Whether the nearest scope that binds the name is a function's; class bodies are not seen from inside functions."""
        at, first = self, True
        while at is not None:
            if name in at.open:
                return False
            if at.kind == "function" and name in at.bound or first and at.kind == "class" and name in at.bound:
                return True
            at, first = at.above, False
        return False


class _Roles(ast.NodeVisitor):
    """Two walks: the first collects what each scope binds, the second gives every identifier its role."""

    def __init__(self, tree: ast.Module) -> None:
        self.top = _Scope(None, "module")
        self.scopes: dict[int, _Scope] = {id(tree): self.top}
        self.modules: dict[str, str] = {}
        self.out: list[dict] = []
        self._bind(tree, self.top)
        self._scope = self.top
        self.visit(tree)

    def _bind(self, node: ast.AST, scope: _Scope) -> None:
        for x in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                scope.bound.add(x.name)
                inner = _Scope(scope, "class" if isinstance(x, ast.ClassDef) else "function")
            elif isinstance(x, ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
                inner = _Scope(scope, "function")
            if inner is not scope:
                self.scopes[id(x)] = inner
            if isinstance(x, ast.Global | ast.Nonlocal):
                if isinstance(x, ast.Global):
                    scope.open.update(x.names)
            elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                scope.bound.add(x.id)
            elif isinstance(x, ast.arg):
                scope.bound.add(x.arg)
            elif isinstance(x, ast.ExceptHandler) and x.name:
                scope.bound.add(x.name)
            elif isinstance(x, ast.Import | ast.ImportFrom):
                for a in x.names:
                    self.modules[a.asname or a.name.split(".")[0]] = a.name if isinstance(x, ast.Import) else a.name
            self._bind(x, inner)

    def _add(self, name: str, line: int, role: str, qualifier: str = "") -> None:
        self.out.append({"name": name, "line": line, "role": role, "qualifier": qualifier})

    def visit(self, node: ast.AST) -> None:
        before = self._scope
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            self._add(node.name, node.lineno, "declaration")
        self._scope = self.scopes.get(id(node), before)
        match node:
            case ast.Import() | ast.ImportFrom():
                for a in node.names:
                    for part in a.name.split("."):
                        if part != "*":
                            self._add(part, node.lineno, "import")
                    if a.asname:
                        self._add(a.asname, node.lineno, "import")
            case ast.arg():
                self._add(node.arg, node.lineno, "binding")
            case ast.keyword() if node.arg:
                self._add(node.arg, node.lineno, "keyword")
            case ast.ExceptHandler() if node.name:
                self._add(node.name, node.lineno, "binding")
            case ast.Attribute():
                base = node.value
                if isinstance(base, ast.Name) and base.id in self.modules and not self._scope.holds(base.id):
                    self._add(base.id, base.lineno, "module_qualifier")
                    self._add(node.attr, node.end_lineno, "module_attribute", self.modules[base.id])
                    self._scope = before
                    return
                self._add(node.attr, node.end_lineno, "attribute")
            case ast.Name():
                if isinstance(node.ctx, ast.Store) and node.id not in self._scope.open:
                    top_constant = self._scope is self.top and _CONSTANT.match(node.id)
                    self._add(node.id, node.lineno, "reference" if top_constant else "binding")
                else:
                    self._add(node.id, node.lineno, "local" if self._scope.holds(node.id) else "reference")
        self.generic_visit(node)
        self._scope = before


def references(text: str | ast.Module) -> list[dict]:
    """Every identifier with its line and role: reference, local, binding, declaration, import, attribute, keyword,
    module_qualifier or module_attribute (with the imported module's own name as qualifier), by line and name."""
    return sorted(_Roles(tree(text)).out, key=lambda r: (r["line"], r["name"], r["role"]))


def _comments(text: str) -> Iterator[tuple[int, str]]:
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            yield t.start[0], t.string.lstrip("#").strip()


def rationales(text: str) -> list[dict]:
    """Comments that give a reason or cite a record, with their citations."""
    out = []
    for line, comment in _comments(text) if "#" in text else ():  # no comment without one
        mark, cited = _RATIONALE.search(comment), _CITATION.findall(comment)
        if mark or cited:
            out.append({"kind": mark[1].lower() if mark else "citation", "text": (mark[2] if mark else comment)[:MAX_RATIONALE], "line": line, "citations": cited})
    return out


def attach(symbols_: list[dict], notes: list[dict]) -> list[tuple[dict, int | None]]:
    """Each note with the place of the innermost symbol around its line, or None."""
    out = []
    for n in notes:
        around = [(s["line"], -i, i) for i, s in enumerate(symbols_) if s["line"] <= n["line"] <= (s["end_line"] or 1 << 60)]
        out.append((n, max(around)[2] if around else None))
    return out


def parameters(signature: str) -> dict:
    """required and total positional parameters of a definition's text; total None if it takes any number."""
    node = ast.parse(signature.rstrip().rstrip(":") + ": ...").body[0]
    a = node.args
    names = [x.arg for x in [*a.posonlyargs, *a.args]]
    own = names[1:] if names[:1] in (["self"], ["cls"]) else names
    return {"required": max(0, len(own) - len(a.defaults)), "total": None if a.vararg else len(own)}


def call_sites(text: str) -> list[dict]:
    """name, line, arguments of each call of a plain name; arguments None if starred or by keyword."""
    out = []
    for x in ast.walk(ast.parse(text)):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
            plain = not x.keywords and not any(isinstance(a, ast.Starred) for a in x.args)
            out.append({"name": x.func.id, "line": x.lineno, "arguments": len(x.args) if plain else None})
    return sorted(out, key=lambda c: (c["line"], c["name"]))


def skeleton(text: str, docstrings: bool = False, numbers: bool = False) -> str:
    """Declarations only: comments and bodies go, a body becomes `...`; with `docstrings` the first doc line stays."""
    lines = text.split("\n")
    tree = ast.parse(text)
    drop: set[int] = set()
    put: dict[int, list[str]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Module):
            doc = ast.get_docstring(node, clean=True)
            first = node.body[0] if node.body else None
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                start, end = first.lineno, node.end_lineno
                pad = " " * first.col_offset
                if start > node.lineno:
                    drop.update(range(start, end + 1))
                    kept = [f'{pad}"""{doc.strip().splitlines()[0][:MAX_DOCSTRING]}"""'] if doc and docstrings else []
                    put.setdefault(start, [*kept, f"{pad}..."])
            elif doc is not None and first is not None:
                drop.update(range(first.lineno, first.end_lineno + 1))
                if docstrings:
                    put.setdefault(first.lineno, [f'{" " * first.col_offset}"""{doc.strip().splitlines()[0][:MAX_DOCSTRING]}"""'])
                elif isinstance(node, ast.ClassDef) and len(node.body) == 1:
                    put.setdefault(first.lineno, [" " * first.col_offset + "..."])
    inner = {n for node in ast.walk(tree) if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and node.body[0].lineno > node.lineno for n in range(node.body[0].lineno + 1, node.end_lineno + 1)}
    cut: dict[int, int] = {}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            cut[t.start[0]] = t.start[1]
    out: list[tuple[int, str]] = []
    for n, line in enumerate(lines, 1):
        if n in put and n not in inner:
            out += [(n, x) for x in put[n]]
        if n in drop:
            continue
        kept = line[: cut[n]].rstrip() if n in cut else line.rstrip()
        if n in cut and not kept:
            continue
        if kept or (out and out[-1][1]):
            out.append((n, kept))
    while out and not out[-1][1]:
        out.pop()
    return "\n".join(f"{n:>5} {x}".rstrip() if numbers else x for n, x in out)


#: Comments that change what tools do, and so count as code.
_DIRECTIVE = re.compile(r"#\s*(type:|noqa|pragma|pylint:|mypy:|ruff:|fmt:|isort:|!|-\*-)")


def stream(text: str) -> str:
    """The tokens with one space between, comments (other than directives) and layout gone, blocks in brackets."""
    out = []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            if _DIRECTIVE.match(t.string):
                out.append(t.string)
        elif t.type == tokenize.INDENT:
            out.append("{")
        elif t.type == tokenize.DEDENT:
            out.append("}")
        elif t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.ENDMARKER):
            out.append(t.string)
    return " ".join(out)


def parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True
