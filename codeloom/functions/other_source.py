"""Facts of sources in other languages, by line patterns. No parser of these languages is available, so this reads
declarations that begin a line; what it cannot see it leaves out, and `capabilities` says which languages are read how."""

from __future__ import annotations

import json
import re

#: File suffixes and their languages.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".rb": "ruby",
    ".sh": "bash", ".bash": "bash", ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".scala": "scala", ".cs": "csharp", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp",
    ".lua": "lua", ".rs": "rust", ".json": "json", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".tf": "hcl", ".hcl": "hcl", ".sql": "sql",
}

_MODS = r"^(?P<pad>\s*)(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|open|override|async|data|pub(?:\([^)]*\))?|unsafe|extern|virtual|inline|case|partial|suspend|fileprivate|implicit|lazy)\s+)*"


def _p(kind: str, rest: str) -> tuple[str, re.Pattern]:
    return kind, re.compile(_MODS + rest)


_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_JS = [_p("class", rf"class\s+{_NAME}"), _p("protocol", rf"interface\s+{_NAME}"), _p("enum", rf"(?:const\s+)?enum\s+{_NAME}"), _p("type_alias", rf"type\s+{_NAME}\s*(?:<[^=]*>)?\s*="), _p("function", rf"function\s*\*?\s*{_NAME}"), _p("function", rf"(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), _p("method", rf"(?!if|for|while|switch|catch|return|function){_NAME}\s*\([^;]*\)\s*(?::[^{{;]+)?\{{\s*$")]
_JVM = [_p("class", rf"(?:class|object|struct|record|extension)\s+{_NAME}"), _p("protocol", rf"(?:interface|trait|protocol)\s+{_NAME}"), _p("enum", rf"enum\s+(?:class\s+)?{_NAME}"), _p("function", rf"(?:fun|func|def)\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}"), _p("method", rf"(?!return|new|else|if|for|while|switch|throw)[\w<>\[\],.?]+\s+{_NAME}\s*\([^;=]*\)\s*(?:throws[^{{]*)?\{{?\s*$")]
_PATTERNS: dict[str, list[tuple[str, re.Pattern]]] = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS, "java": _JVM, "kotlin": _JVM, "swift": _JVM, "scala": _JVM, "csharp": _JVM,
    "go": [("function", re.compile(rf"^(?P<pad>)func\s+(?:\(\s*\w*\s*\*?(?P<parent>\w+)[^)]*\)\s*)?{_NAME}"))],
    "ruby": [_p("class", r"class\s+(?P<name>[\w:]+)"), _p("class", r"module\s+(?P<name>[\w:]+)"), _p("function", r"def\s+(?:self\.)?(?P<name>[\w?!=]+)")],
    "bash": [_p("function", r"(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?"), _p("function", r"function\s+(?P<name>[\w-]+)\s*\{?")],
    "php": [_p("class", rf"(?:class|trait)\s+{_NAME}"), _p("protocol", rf"interface\s+{_NAME}"), _p("enum", rf"enum\s+{_NAME}"), _p("function", rf"function\s+&?{_NAME}")],
    "c": [_p("class", rf"(?:typedef\s+)?struct\s+{_NAME}\s*\{{"), _p("enum", rf"(?:typedef\s+)?enum\s+{_NAME}\s*\{{"), ("function", re.compile(rf"^(?P<pad>)(?!return|else|typedef|#)[A-Za-z_][\w\s*]*?[\s*]{_NAME}\s*\([^;]*\)\s*\{{?\s*$"))],
    "lua": [("function", re.compile(r"^(?P<pad>\s*)(?:local\s+)?function\s+(?:(?P<parent>\w+)[.:])?(?P<name>\w+)")), ("function", re.compile(r"^(?P<pad>\s*)(?:(?P<parent>\w+)\.)?(?P<name>\w+)\s*=\s*function")), ("class", re.compile(r"^(?P<pad>)local\s+(?P<name>[A-Z]\w*)\s*=\s*\{\s*\}")), ("constant", re.compile(r"^(?P<pad>)(?:local\s+)?(?P<name>[A-Z][A-Z0-9_]+)\s*="))],
    "rust": [_p("class", rf"struct\s+{_NAME}"), _p("enum", rf"enum\s+{_NAME}"), _p("protocol", rf"trait\s+{_NAME}"), _p("constant", rf"(?:const|static)\s+{_NAME}\s*:"), _p("type_alias", rf"type\s+{_NAME}"), _p("function", rf"fn\s+{_NAME}"), ("_impl", re.compile(r"^(?P<pad>\s*)impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)"))],
    "sql": [("class", re.compile(r"(?i)^(?P<pad>\s*)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?(?P<name>\w+)")), ("type_alias", re.compile(r"(?i)^(?P<pad>\s*)create\s+(?:or\s+replace\s+)?view\s+[\"`]?(?P<name>\w+)")), ("_column", re.compile(r"(?i)^(?P<pad>\s+)(?!primary|foreign|unique|check|constraint|select|from|where)[\"`]?(?P<name>\w+)\s+[a-z]"))],
    "hcl": [("class", re.compile(r'^(?P<pad>\s*)\w+(?:\s+"[^"]+")*?\s+"(?P<name>[^"]+)"\s*\{')), ("class", re.compile(r"^(?P<pad>\s*)(?P<name>\w+)\s*\{")), ("constant", re.compile(r"^(?P<pad>\s*)(?P<name>\w+)\s*=[^=]"))],
    "toml": [("class", re.compile(r"^(?P<pad>)\[+(?P<name>[^\]]+)\]+")), ("constant", re.compile(r"^(?P<pad>\s*)(?P<name>[\w.\"-]+)\s*="))],
    "yaml": [("class", re.compile(r"^(?P<pad>\s*)(?:- )?(?P<name>[\w./-]+):\s*(?:#.*)?$")), ("constant", re.compile(r"^(?P<pad>\s*)(?:- )?(?P<name>[\w./-]+):\s+\S"))],
}
_PATTERNS["cpp"] = [_p("class", rf"class\s+{_NAME}[^;]*$"), *_PATTERNS["c"]]
_CONTAINERS = {"class", "protocol", "enum", "_impl"}
_IMPORTS: dict[str, re.Pattern] = {
    "javascript": re.compile(r"""^\s*(?:import|export)\b[^'"]*?(?:from\s*)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]"""), "go": re.compile(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$'), "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
    "c": re.compile(r'^\s*#\s*include\s*([<"][^>"]+[>"])'), "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([^;]+);"), "lua": re.compile(r"""\brequire\s*\(?\s*['"]([^'"]+)['"]"""), "ruby": re.compile(r"""^\s*require(?:_relative)?\s*\(?['"]([^'"]+)['"]"""),
    "bash": re.compile(r"^\s*(?:source|\.)\s+([^\s;]+)"), "csharp": re.compile(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"), "php": re.compile(r"""^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"])"""),
}
for _same, _as in (("typescript", "javascript"), ("tsx", "javascript"), ("kotlin", "java"), ("scala", "java"), ("swift", "java"), ("cpp", "c")):
    _IMPORTS[_same] = _IMPORTS[_as]


def capabilities() -> list[tuple[str, str]]:
    """(language, how it is read)."""
    return sorted({(lang, "parser" if lang in ("python", "json") else "line patterns" if lang in _PATTERNS else "none") for lang in LANGUAGES.values()})


def _json_symbols(text: str) -> list[dict]:
    out: list[dict] = []
    lines = text.split("\n")

    def walk(value: object, owner: str, at: int) -> int:
        for k, v in value.items() if isinstance(value, dict) else []:
            mark = json.dumps(k, ensure_ascii=False)
            line = next((i for i in range(at, len(lines)) if mark in lines[i]), at)
            at = line
            nested = isinstance(v, dict) and bool(v)
            out.append({"name": k, "kind": "class" if nested else "constant", "line": line + 1, "end_line": None, "parent": owner, "signature": lines[line].strip()[:80]})
            at = walk(v, f"{owner}.{k}" if owner else k, at)
        return at

    walk(json.loads(text), "", 0)
    return out


def symbols(text: str, language: str) -> list[dict]:
    """Declarations in source order; a nested one names the container whose indentation it is inside of."""
    if language == "json":
        return _json_symbols(text)
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    table = ""
    for n, line in enumerate(text.split("\n"), 1):
        for kind, pattern in _PATTERNS.get(language, []):
            m = pattern.match(line)
            if not m:
                continue
            pad, name = len((m["pad"] or "").expandtabs(4)), m["name"]
            while stack and stack[-1][0] >= pad:
                stack.pop()
            owner = m.groupdict().get("parent") or ".".join(x for _, x in stack)
            if language == "sql":
                owner = table if kind == "_column" else ""
                if kind == "_column" and not table:
                    break
                table = name if kind == "class" else table if kind == "_column" else ""
            if language == "toml":
                owner = stack[0][1] if kind == "constant" and stack else ""
                stack = [(-1, name)] if kind == "class" else stack
            kind = "constant" if kind == "_column" else "method" if kind == "function" and owner else kind
            if kind == "method" and not owner:
                break
            if kind != "_impl":
                out.append({"name": name, "kind": kind, "line": n, "end_line": None, "parent": owner, "signature": line.strip()[:80]})
            if kind in _CONTAINERS and language not in ("toml", "sql"):
                stack.append((pad, name))
            break
    return out


def imports(text: str, language: str) -> list[dict]:
    pattern = _IMPORTS.get(language)
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        m = pattern.search(line) if pattern else None
        if m:
            module = next(g for g in m.groups() if g)
            near = module.startswith((".", '"', "self::", "super::", "crate::")) or "require_relative" in line
            out.append({"module": module.strip('"<>'), "names": [], "is_relative": near, "level": 0, "line": n})
    return out


_WORD = re.compile(r"[A-Za-z_$][\w$]*")


def references(text: str, language: str) -> list[dict]:
    """Every identifier outside strings' quotes, as a reference; declared names as declarations."""
    declared = {(s["name"], s["line"]) for s in symbols(text, language)}
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        for name in _WORD.findall(re.sub(r"""(['"]).*?\1|//.*|#\s.*""", " ", line)):
            out.append({"name": name, "line": n, "role": "declaration" if (name, n) in declared else "reference", "qualifier": ""})
    return out
