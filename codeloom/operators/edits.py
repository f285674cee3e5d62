"""Applying edits to files and telling equal changes apart."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import python_source

ELISION = "..."
OUTCOMES = "candidate string, path string, at int, status string, matches int, text string"


def find_lines(lines: list[str], wanted: list[str], spans: list[list[int]] | None = None) -> list[int]:
    """Places where `wanted` stands as whole lines; with 1-based inclusive spans (end -1: to the end), inside one of them."""
    n = len(wanted)
    out = [i for i in range(len(lines) - n + 1) if lines[i : i + n] == wanted]
    if spans:
        out = [i for i in out if any(a <= i + 1 and (b == -1 or i + n <= b) for a, b in spans)]
    return out


def apply_one(lines: list[str], search: str, replace: str, spans: list[list[int]] | None) -> tuple[str, int, list[str], int, int]:
    """(status, matches, new lines, place, change of length)."""
    if search == ELISION:
        anchors = [i for i in find_lines(lines, [], None) if i < len(lines) and lines[i] and not lines[i][0].isspace() and lines.count(lines[i]) == 1]
        anchors = [i for i in anchors if not spans or any(a <= i + 1 and (b == -1 or i + 1 <= b) for a, b in spans)]
        if not anchors:
            return "no_anchor", 0, lines, -1, 0
        new = replace.removeprefix(ELISION + "\n").split("\n")
        at = anchors[0]
        return "applied", 1, [*lines[: at + 1], *new, *lines[at + 1 :]], at, len(new)
    wanted, new = search.removeprefix(ELISION + "\n").split("\n"), replace.removeprefix(ELISION + "\n").split("\n")
    new = [] if replace == "" else new
    found = find_lines(lines, wanted, spans)
    if not found:
        everywhere = find_lines(lines, wanted)
        return ("outside_intervals" if everywhere else "not_found"), len(everywhere), lines, -1, 0
    if len(found) > 1:
        return "ambiguous", len(found), lines, -1, 0
    at = found[0]
    return "applied", 1, [*lines[:at], *new, *lines[at + len(wanted) :]], at, len(new) - len(wanted)


def apply_edits(edits: DataFrame, files: DataFrame) -> DataFrame:
    """candidate, path, at, status, matches, and text on each file's last row: edits of a file in order, each on what the one
    before left; matches must be unique whole lines. `files` has path, text and optionally spans array<array<int>>, which
    move with the edits above them. A file that is not there gives no_such_file."""
    if "spans" not in files.columns:
        files = files.withColumn("spans", F.lit(None).cast("array<array<int>>"))
    each = edits.where("error is null").groupBy("candidate", "path").agg(F.array_sort(F.collect_list(F.struct("at", "search", "replace"))).alias("edits"))
    rows = each.join(files.select("path", "text", "spans"), "path", "left").select("candidate", "path", "edits", "text", "spans")
    schema = pa.schema([(c, pa.int32() if c in ("at", "matches") else pa.string()) for c in ("candidate", "path", "at", "status", "matches", "text")])

    def apply_all(candidate: str, path: str, todo: list[dict], text: str | None, spans: list[list[int]] | None) -> Iterator[dict]:
        lines = text.split("\n") if text is not None else []
        for k, e in enumerate(todo):
            status, n = "no_such_file", 0
            if text is not None:
                status, n, lines, place, grown = apply_one(lines, e["search"], e["replace"], spans)
                if status == "applied" and spans:
                    spans = [[a + grown if a > place + 1 else a, b if b == -1 else b + grown if b > place else b] for a, b in spans]
            last = text is not None and k == len(todo) - 1
            yield {"candidate": candidate, "path": path, "at": e["at"], "status": status, "matches": n, "text": "\n".join(lines) if last else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in apply_all(*row)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, OUTCOMES)


def normal(text: str, language: str | None) -> str:
    """The token stream of a Python text that can be read, else the text with white space collapsed."""
    if language == "python":
        try:
            return python_source.stream(text)
        except (SyntaxError, ValueError):
            pass
    return re.sub(r"\s+", " ", text).strip()


def change_key(old: str, new: str, language: str | None) -> str:
    """sha256 of the diff between the two normal forms; equal forms give the key of no change."""
    diff = difflib.unified_diff([normal(old, language)], [normal(new, language)], lineterm="", n=0)
    return hashlib.sha256("\n".join(diff).encode()).hexdigest()


def change_keys(changes: DataFrame) -> DataFrame:
    """candidate, path, key, parses (the new text reads no worse than the old) of `changes` (candidate, path, lang, old, new)."""

    def run(batches):
        for pdf in batches:
            rows = [(c, p, change_key(o or "", n or "", g), g != "python" or python_source.parses(n or "") or not python_source.parses(o or "")) for c, p, g, o, n in zip(pdf["candidate"], pdf["path"], pdf["lang"], pdf["old"], pdf["new"], strict=True)]
            yield pd.DataFrame(rows, columns=["candidate", "path", "key", "parses"])

    return changes.select("candidate", "path", "lang", "old", "new").mapInPandas(run, "candidate string, path string, key string, parses boolean")


def oriented(edits: DataFrame, files: DataFrame) -> DataFrame:
    """candidate, path, at, facing: forward if the search side stands in the file, reversed if only the replacement does."""
    wrap = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    rows = edits.where("error is null").join(files.select("path", "text"), "path", "left")
    facing = F.when(F.col("text").isNull(), "no_such_file").when(F.contains(wrap(F.col("text")), wrap(F.col("search"))), "forward").when(F.contains(wrap(F.col("text")), wrap(F.col("replace"))), "reversed").otherwise("neither")
    return rows.select("candidate", "path", "at", facing.alias("facing"))
