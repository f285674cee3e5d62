"""Source trees as fact tables: files, symbols, imports, references, skipped."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import other_source, python_source
from codeloom.plans.lineage import dealt

MAX_DEPTH, MAX_FILES, MAX_BYTES, MAX_FILE_BYTES = 20, 20_000, 200_000_000, 1_000_000
FACTS = (
    "path string, fact string, ordinal int, name string, kind string, line int, end_line int, signature string, parent string, docstring string, decorators array<string>, bases array<string>, "
    "is_public boolean, is_async boolean, module string, names array<string>, is_relative boolean, level int, role string, qualifier string, reason string, citations array<string>"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in FACTS.split(", "))])


def scan(spark: SparkSession, root: str, *, max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size, text of all files under `root`; refuses trees beyond the bounds before any content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "^[a-z]+:/*", "/")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = raw.select(F.replace(base, F.lit(start), F.lit("")).alias("path"), F.col("length").alias("size"), "content")
    n, total, deep = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(0))).first()
    if n > max_files or total > max_bytes or deep > max_depth:
        raise ValueError(f"tree too large: {n} files, {total} bytes, depth {deep}")
    return rows.select("path", "size", F.when(F.col("size") <= MAX_FILE_BYTES, F.decode("content", "utf-8")).alias("text"))


def with_language(files: DataFrame) -> DataFrame:
    """files with `lang` by suffix; files of no known language go."""
    spark = files.sparkSession
    table = spark.createDataFrame(list(other_source.LANGUAGES.items()), "suffix string, lang string")
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))).join(F.broadcast(table), "suffix").drop("suffix")  # a few dozen suffixes


def _facts(path: str, lang: str, text: str | None) -> list[dict]:
    if text is None:
        return [{"fact": "skipped", "reason": f"larger than {MAX_FILE_BYTES} bytes"}]
    python = lang == "python"
    try:
        tree = python_source.tree(text) if python else None
        found = python_source.symbols(tree) if python else other_source.symbols(text, lang)
        out = [{"fact": "symbol"} | s for s in found]
        out += [{"fact": "import"} | s for s in (python_source.imports(tree) if python else other_source.imports(text, lang))]
        out += [{"fact": "reference"} | s for s in (python_source.references(tree) if python else other_source.references(text, lang))]
        if python:
            for note, at in python_source.attach(found, python_source.rationales(text)):
                out.append({"fact": "rationale", "kind": note["kind"], "signature": note["text"], "line": note["line"], "citations": note["citations"], "parent": found[at]["name"] if at is not None else ""})
        return out
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"fact": "skipped", "reason": f"{type(e).__name__}: {getattr(e, 'msg', e)}"}]


def extract(files: DataFrame, wanted: Collection[str] = ("symbol", "import", "reference", "rationale", "skipped"), rows: int = 20_000) -> DataFrame:
    """One row a fact of files (path, lang, text); a file that cannot be read becomes one row `skipped` with its reason.

    Only facts of the `wanted` kinds are handed over; every file is read whole for all of them, so that the same files are
    skipped whatever is wanted.
    """
    names = list(_SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f.get(c) for f in out], t) for c, t in zip(names, _SCHEMA.types, strict=True)], schema=_SCHEMA)

        for batch in batches:
            out: list[dict] = []
            for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out += [f | {"path": path, "ordinal": i} for i, f in enumerate(_facts(path, lang, text)) if f["fact"] in wanted]
                if len(out) >= rows:
                    yield table(out)
                    out = []
            yield table(out)

    return dealt(files.select("path", "lang", "text"), "path").mapInArrow(run, FACTS)


def symbols(facts: DataFrame) -> DataFrame:
    """The symbols with `ordinal` (of equal names in one parent and file) and `duplicate`."""
    same = W.partitionBy("path", "parent", "name").orderBy("line", "ordinal")
    out = facts.where("fact = 'symbol'").withColumn("duplicate", F.row_number().over(same) - 1)
    return out.select("path", "name", "kind", "line", "end_line", "signature", "parent", "docstring", "decorators", "bases", "is_public", "is_async", F.col("duplicate").alias("ordinal"))


def imports(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'import'").select(F.col("path").alias("importer"), "module", "names", "is_relative", F.coalesce("level", F.lit(0)).alias("level"), "line")


def references(facts: DataFrame, resolvable: bool = False) -> DataFrame:
    roles = ["reference", "module_attribute"] if resolvable else ["reference"]
    return facts.where((F.col("fact") == "reference") & F.col("role").isin(roles)).select("path", "name", "line", "role", "qualifier")


def skipped(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'skipped'").select("path", "reason")
