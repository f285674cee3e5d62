"""What a tree says about itself: version state, settings, declared dependencies, allowed roots. Driver-side and small."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

#: The settings' bounds.
BUDGET, FILES, STOP_ENTRIES, STOP_LENGTH, COMMAND, FILE_BYTES, UNKNOWN_SHOWN = (200, 64_000), (1, 200), 200, 64, 512, 64 * 1024, 8


@dataclass
class Settings:
    map_budget: int | None = None
    max_files: int | None = None
    granularity: str | None = None
    docstrings: bool | None = None
    stoplist: frozenset[str] = frozenset()
    test_cmd: str | None = None
    warnings: list[str] = field(default_factory=list)


def settings(text: str) -> Settings:
    """Settings of a JSON text; whatever is out of bounds is left out with a warning, never bent."""
    out = Settings()
    try:
        if len(text.encode()) > FILE_BYTES:
            raise ValueError("too large")
        data = json.loads(text)
        if not isinstance(data, dict):
            raise ValueError("not an object")
    except ValueError as e:
        out.warnings.append(f"settings ignored: {e}")
        return out

    def whole(lo: int, hi: int):
        return lambda x: isinstance(x, int) and not isinstance(x, bool) and lo <= x <= hi

    fits = {
        "map_budget": whole(*BUDGET), "max_files": whole(*FILES), "granularity": lambda x: x in ("function", "file"), "docstrings": lambda x: isinstance(x, bool),
        "test_cmd": lambda x: isinstance(x, str) and 0 < len(x) <= COMMAND, "stoplist": lambda x: isinstance(x, list) and len(x) <= STOP_ENTRIES,
    }
    unknown = sorted(k for k in data if k not in fits)
    out.warnings += [f"unknown key {k[:STOP_LENGTH]!r}" for k in unknown[:UNKNOWN_SHOWN]] + ([f"{len(unknown) - UNKNOWN_SHOWN} more unknown keys"] if len(unknown) > UNKNOWN_SHOWN else [])
    for key, ok in fits.items():
        if key not in data:
            continue
        if not ok(data[key]):
            out.warnings.append(f"{key} is out of bounds")
        elif key == "stoplist":
            good = [x for x in data[key] if isinstance(x, str) and re.fullmatch(r"[^\s/\\:;'\"`$*?<>|\0]{1,%d}" % STOP_LENGTH, x)]
            if len(good) < len(data[key]):
                out.warnings.append("stoplist entries left out")
            out.stoplist = frozenset(good)
        else:
            setattr(out, key, data[key])
    return out


def state(root: str) -> dict:
    """head (8 digits), tree, dirty (files) of a git tree; what cannot be told is None, with a note."""
    out: dict = {"head": None, "tree": None, "dirty": None, "note": ""}
    for key, args in (("head", ["rev-parse", "--short=8", "HEAD"]), ("tree", ["rev-parse", "HEAD^{tree}"]), ("dirty", ["status", "--porcelain"])):
        try:
            got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=20, check=True).stdout.strip()
            out[key] = len(got.splitlines()) if key == "dirty" else got
        except (OSError, subprocess.SubprocessError):
            out["note"] = out["note"] or f"{key} is unknown"
    return out


def tracked(root: str) -> list[str] | None:
    """Files that git would not ignore, sorted; None without git."""
    try:
        got = subprocess.run(["git", "-C", root, "ls-files", "-coz", "--exclude-standard"], capture_output=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted({x for x in got.decode("utf-8", "replace").split("\0") if x})


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def declared(manifest: str) -> list[str]:
    """Normalised names that a pyproject text declares: project, optional and group dependencies."""
    data = tomllib.loads(manifest)
    project = data.get("project", {})
    found = [*project.get("dependencies", []), *(x for v in project.get("optional-dependencies", {}).values() for x in v), *(x for v in data.get("dependency-groups", {}).values() for x in v if isinstance(x, str))]
    return sorted({normal_name(m[0]) for x in found if (m := re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", x.strip()))})


def contained(root: str, candidate: str) -> Path:
    """The candidate inside root, links followed; refuses whatever leads out."""
    base = Path(root).resolve()
    full = (base / candidate).resolve()
    if full != base and base not in full.parents:
        raise ValueError("path leads out of the root")
    return full


def allowed(root: str, roots: list[str]) -> str:
    """The root, if it is one of the allowed ones exactly."""
    full = str(Path(root).resolve())
    if full not in {str(Path(r).resolve()) for r in roots}:
        raise PermissionError("root is not allowed")
    return full


def intervals(ranges: object) -> list[tuple[int, int]]:
    """Pairs of 1-based lines (end -1: to the end); one wrong pair refuses all."""
    if not isinstance(ranges, list | tuple):
        raise ValueError("ranges must be a list")
    out = []
    for r in ranges:
        if not (isinstance(r, list | tuple) and len(r) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in r) and r[0] >= 1 and (r[1] == -1 or r[1] >= r[0])):
            raise ValueError(f"not a range: {r!r}")
        out.append((r[0], r[1]))
    return out
