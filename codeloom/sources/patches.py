"""Candidate changes as tables: marked blocks, unified diffs, JSON edits, verdict records, candidate folders, manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.plans.lineage import dealt

#: The block format's marks.
SEARCH, DIVIDER, REPLACE, FENCE, ELISION = "<<<<<<< SEARCH", "=======", ">>>>>>> REPLACE", "```", "..."
FOREIGN = "*** Begin Patch"
EDITS = "candidate string, at int, path string, search string, replace string, error string"


def _row(at: int, path: str | None, search: str = "", replace: str = "", error: str | None = None) -> dict:
    return {"at": at, "path": path, "search": search, "replace": replace, "error": error}


def _path_in(header: str) -> str | None:
    """The last header line that looks like a path."""
    for line in reversed(header.split("\n")):
        line = line.strip().removeprefix("###").strip()
        if line and not line.startswith(FENCE) and re.fullmatch(r"[^\s:*?\"<>|]+(?: [^\s:*?\"<>|]+)*\.?[\w/-]+", line) and ("/" in line or "." in line):
            return line
    return None


def blocks(text: str) -> list[dict]:
    """One row a block, in order; a malformed block is a row with an error, and no block at all is one too."""
    out: list[dict] = []
    state, path, header, search, replace = "header", None, [], [], []

    def fail(why: str) -> None:
        out.append(_row(len(out), path, error=why))

    for line in text.split("\n"):
        mark = line.rstrip()
        if mark.startswith(SEARCH):
            if state != "header":
                fail("a block begins inside another")
            path = _path_in("\n".join(header)) or path
            header, search, replace, state = [], [], [], "search"
            if mark != SEARCH:
                fail("text follows the search mark on its line")
                state = "bad"
        elif mark == DIVIDER and state == "search":
            state = "replace"
        elif mark == DIVIDER and state == "replace":
            fail("more than one divider")
            state = "bad"
        elif mark == REPLACE:
            if state == "replace":
                s, r = "\n".join(search), "\n".join(replace)
                if path is None:
                    fail("block names no file")
                elif s == ELISION and r == ELISION or s.startswith(ELISION + "\n") and r.startswith(ELISION + "\n") and s == r:
                    fail("both sides are elided")
                else:
                    out.append(_row(len(out), path, s, r))
            elif state == "search":
                fail("block has no divider")
            elif state == "header":
                fail("a block ends that did not begin")
            header, state = [], "header"
        elif state == "header":
            header.append(line)
        elif state == "search":
            search.append(line)
        elif state == "replace":
            replace.append(line)
    if state not in ("header", "bad") or (state == "bad" and not out):
        fail("block is not terminated")
    if not out:
        fail("no blocks found" + ("; this is another patch dialect" if FOREIGN in text else ""))
    return out


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def unified(text: str) -> list[dict]:
    """One row a hunk, its body taken by the declared counts; renames, copies, context-free and combined diffs are errors."""
    out: list[dict] = []
    lines = text.replace("\r\n", "\n").split("\n")
    old = path = None
    i = 0

    def fail(why: str) -> None:
        out.append(_row(len(out), path, error=why))

    while i < len(lines):
        line = lines[i]
        if line.startswith(("rename from", "copy from")):
            fail("renames and copies are not edits")
        elif line.startswith(("Binary files", "GIT binary patch")):
            fail("binary change")
        elif line.startswith("@@@"):
            fail("combined diff")
        elif line.startswith("--- "):
            old = line[4:].split("\t")[0]
        elif line.startswith("+++ "):
            new = line[4:].split("\t")[0]
            path = re.sub(r"^[ab]/", "", old if new == "/dev/null" else new)
        elif m := _HUNK.match(line):
            want = [int(m[k]) if m[k] is not None else 1 for k in (2, 4)]
            before, after = [], []
            while i + 1 < len(lines) and (len(before) < want[0] or len(after) < want[1]):
                i += 1
                kind, rest = lines[i][:1], lines[i][1:]
                if kind in ("-", " ", ""):
                    before.append(rest)
                if kind in ("+", " ", ""):
                    after.append(rest)
                if kind not in ("-", "+", " ", "", "\\"):
                    break
            if (len(before), len(after)) != tuple(want):
                fail("hunk is shorter than it says")
            elif path is None:
                fail("hunk names no file")
            elif want[0] == len([x for x in before if x not in after]) and want[0] and want[1] and not set(before) & set(after):
                fail("hunk has no context")
            else:
                out.append(_row(len(out), path, "\n".join(before), "\n".join(after)))
        i += 1
    if not out:
        fail("no hunks found")
    return out


def json_edits(text: str) -> list[dict]:
    """Rows of `{"edits": [{"path", "search", "replace"}]}`; anything else is refused as a whole."""
    try:
        edits = json.loads(text)["edits"]
        assert isinstance(edits, list) and edits
        for e in edits:
            assert set(e) == {"path", "search", "replace"} and all(isinstance(x, str) for x in e.values())
    except (AssertionError, KeyError, TypeError, ValueError, AttributeError):
        return [_row(0, None, error="not a list of typed edits")]
    return [_row(i, e["path"], e["search"], e["replace"]) for i, e in enumerate(edits)]


def any_edits(text: str) -> list[dict]:
    """By the text's own look: JSON, unified diff, else marked blocks."""
    if text.lstrip().startswith("{"):
        return json_edits(text)
    if SEARCH not in text and re.search(r"^(--- |diff --git )", text, re.M):
        return unified(text)
    return blocks(text)


def parse(candidates: DataFrame, form: str = "any") -> DataFrame:
    """candidate, at, path, search, replace, error of each edit in `candidates` (candidate, text)."""
    read = {"any": any_edits, "blocks": blocks, "unified": unified, "json": json_edits}[form]

    schema = pa.schema([(c, pa.int32() if c == "at" else pa.string()) for c in ("candidate", "at", "path", "search", "replace", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"candidate": c} | r for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in read(t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return dealt(candidates.select("candidate", "text"), "candidate", "text").mapInArrow(run, EDITS)


def candidate_folder(spark: SparkSession, path: str) -> DataFrame:
    """candidate (file stem), index (place in name order), text of each file in a folder."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("candidate"), (F.row_number().over(W.orderBy("file")) - 1).alias("index"), "text")


VERDICTS = "record string, id string, index int, apply struct<status:string,reasons:array<string>>, regression string, reproduction string, equivalence_key string, duration double"


def verdict_records(spark: SparkSession, path: str) -> DataFrame:
    """The candidate records of a JSON-lines file whose first record describes the run; wrong types are refused."""
    return spark.read.schema(VERDICTS).option("mode", "FAILFAST").json(path).where("record = 'candidate'").drop("record")


def requirements(lines: DataFrame) -> DataFrame:
    """name of each requirement line (value), normalised."""
    name = F.regexp_extract(F.trim("value"), "^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return lines.select(F.lower(F.regexp_replace(name, "[-_.]+", "-")).alias("name")).where("name <> ''").distinct()
