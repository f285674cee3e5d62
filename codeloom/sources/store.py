"""Writes on the driver: generations of fact tables behind a pointer, one writer at a time, and files that appear whole."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


class Busy(Exception):
    """Another writer holds the lock."""


@contextmanager
def writing(spark: SparkSession, root: str) -> Iterator[None]:
    """The only writer of `root`: its lock file is made if it does not exist, in one step of the file system. Readers need none."""
    fs, path = _fs(spark, root)
    lock = path(f"{root}/_lock")
    fs.mkdirs(path(root))
    if not fs.createNewFile(lock):
        raise Busy(f"{root} has a writer; remove {root}/_lock if it ended without removing it")
    try:
        yield
    finally:
        fs.delete(lock, False)


def publish(tables: Mapping[str, DataFrame], root: str, generation: str) -> None:
    """Writes the tables as one generation, then lets the marker file `_at-generation` name it.

    Readers see the generation before or this one, never a part: the marker is made after all tables are there. A name
    stands for its contents (as a digest does): a generation published before is named again, not written again, so that
    who reads it is not disturbed; what a lost writer left without a marker is overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    with writing(spark, root):
        known = _markers(spark, root)
        if generation not in {g for _, g in known}:
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{root}/{generation}/{name}")
        fs, path = _fs(spark, root)
        last = max((n for n, _ in known), default=0)
        fs.createNewFile(path(f"{root}/_at-{last + 1:09d}-{generation}"))


def _markers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, path = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.globStatus(path(f"{root}/_at-*")) or []]
    return [(int(n.split("-", 2)[1]), n.split("-", 2)[2]) for n in names]


def current(spark: SparkSession, root: str) -> str | None:
    """The generation published last, None before the first."""
    return max(_markers(spark, root), default=(0, None))[1]


def table(spark: SparkSession, root: str, name: str, generation: str | None = None) -> DataFrame:
    """A table of a generation, the present one by default; a reader that names it keeps it while writers go on."""
    at = generation or current(spark, root)
    if at is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{at}/{name}")


def _staged(target: Path, text: str) -> str:
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".staged-")
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    if target.exists():
        os.chmod(name, target.stat().st_mode & 0o777)
    return name


def write_page(folder: str | Path, name: str, text: str) -> Path:
    """A page in `folder`, replaced in one step; `name` must be a bare file name that ends in .html."""
    if Path(name).name != name or not name.endswith(".html") or name.startswith("."):
        raise ValueError(f"not a bare name of a page: {name!r}")
    target = Path(folder) / name
    target.parent.mkdir(parents=True, exist_ok=True)
    os.replace(_staged(target, text), target)
    return target


def write_all(base: str | Path, contents: Mapping[str, str]) -> None:
    """Writes all files below `base` or none: all are staged first, and what was replaced is put back if a later one fails."""
    base = Path(base).resolve()
    targets = {p: (base / p).resolve() for p in contents}
    if outside := [p for p, t in targets.items() if not t.is_relative_to(base)]:
        raise ValueError(f"outside the tree: {outside}")
    staged, before, made = {}, {}, []
    try:
        for p, t in targets.items():
            for folder in reversed([f for f in t.parents if not f.exists()]):
                folder.mkdir()
                made.append(folder)
            staged[p] = _staged(t, contents[p])
        for p, t in targets.items():
            old = t.read_bytes() if t.exists() else None
            os.replace(staged[p], t)
            before[p] = old
            del staged[p]
    except BaseException:
        for p, old in before.items():
            targets[p].unlink() if old is None else targets[p].write_bytes(old)
        for name in staged.values():
            os.unlink(name)
        for folder in reversed(made):
            folder.rmdir()
        raise
