"""Removal of word passages that an earlier document also holds, found through difference-cover anchors.

Method. A difference cover D modulo v holds, for each shift d, two members that differ by d. Two equal windows that begin
at p and q therefore share an offset h < v with p+h and q+h both at cover places, so hashing runs of `window - v + 1`
words at cover places only (6 of 31 here) loses no equal window. A run that two documents share is an anchor; each anchor
is extended to all windows that hold it, and those windows are compared in full.

Plan. Rows are dealt once into units of a few MB by a hash of doc_id and text, so that neither null ids nor many texts under
one id meet in a unit (the exchange is reused by every later step).
A unit reports the distinct hashes it holds, packed into one binary value for each range of the hash space; a range
compares the units' reports and answers each of them. A passage that a third of all documents hold costs one entry per
unit and never meets in one task, nothing is joined row by row, and no pairs are made.

    units -> anchor reports -> ranges -> shared anchors -> units -> window reports -> ranges -> "held earlier" bits -> units

Defined results. Null text: no words, nothing removed. Fewer than `window` words: nothing removed. Rows with the same
doc_id count as one document: they never remove each other's words. Null doc_id: neither a source nor changed. Repeated
passages inside one document stay. Extra columns are ignored (result has the columns named below). Windows are judged on
the input. An empty table gives an empty result. A window's identity is its 64-bit hash, within windows that also share
an anchor under another 64-bit hash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm.common import bound_batches, free_memory, text_buffer, text_size
from codeloom.llm.wordhash import row_bounds, run_hashes, word_hashes, words

#: Perfect difference sets, modulus -> members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_ANCHOR_BASE = 0xA0761D6478BD642F
UNIT_BYTES = 4 << 20
#: Hashes that one range of the hash space takes in.
RANGE_HASHES = 1 << 20
#: Hashes that a unit reports to one range at least, on average: more ranges would make rows of a hash or two.
LEAST_HASHES = 16


def period(window: int) -> int:
    """The largest period of which a cover is known and that leaves anchors of at least window / 3 words."""
    fit = [v for v in COVERS if v <= window - window // 3 + 1 and v <= window]
    if not fit:
        raise ValueError("window is too short")
    return max(fit)


def _read(docs: pa.Table, window: int):
    """The unit's words and, of each row, its anchors' places and hashes."""
    data, offsets = text_buffer(docs.column("text"))
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    bounds = row_bounds(rows, docs.num_rows)
    v = period(window)
    size = window - v + 1
    runs = run_hashes(hashes, size, _ANCHOR_BASE)
    place = np.arange(len(runs)) - bounds[rows[: len(runs)]]
    fits = rows[: len(runs)] == rows[size - 1 :] if len(runs) else np.zeros(0, bool)
    cover = np.zeros(v, bool)
    cover[list(COVERS[v])] = True
    at = np.flatnonzero(fits & cover[place % v])
    return data, starts, ends, rows, hashes, bounds, at, runs[at]


def _ranges(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _report(unit: int, hashes: np.ndarray, extra: np.ndarray, bits: int) -> dict[str, list]:
    """Rows for sorted hashes, one for each range that has some."""
    part = _ranges(hashes, bits)
    parts = np.unique(part)
    at = np.searchsorted(part, [*parts, part[-1] + 1 if len(part) else 0])
    return {
        "_part": parts.tolist(),
        "_unit": [unit] * len(parts),
        "_hash": [hashes[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)],
        "_more": [extra[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)],
    }


_REPORT = pa.schema([("_part", pa.int64()), ("_unit", pa.int64()), ("_hash", pa.binary()), ("_more", pa.binary())])
_REPORT_DDL = "_part long, _unit long, _hash binary, _more binary"
_ANSWER = pa.schema([("_unit", pa.int64()), ("_kind", pa.int32()), ("_part", pa.int64()), ("_blob", pa.binary())])
_ANSWER_DDL = "_unit long, _kind int, _part long, _blob binary"


def _least_doc(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted hashes, least doc of each, index of the distinct hash for each input)."""
    if not len(hashes):
        return hashes, doc, np.zeros(0, np.int64)
    order = np.lexsort((doc, hashes))
    h = hashes[order]
    first = np.r_[True, h[1:] != h[:-1]]
    index = np.empty(len(hashes), np.int64)
    index[order] = np.cumsum(first) - 1
    return h[first], doc[order][first], index


def _doc_ids(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = docs.column("doc_id")
    return column.fill_null(0).to_numpy().astype(np.int64), ~column.is_null().to_numpy()


def _windows(docs: pa.Table, answers: pa.Table, window: int):
    """What _read gives, and each candidate window's place, hash and document: those that hold an anchor shared by two documents."""
    data, starts, ends, rows, hashes, bounds, at, anchors = _read(docs, window)
    ids, known = _doc_ids(docs)
    kind = answers.column("_kind").to_numpy()
    blobs = answers.column("_blob").to_pylist()
    shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b, k in zip(blobs, kind, strict=True) if k == 0)]))
    if len(shared) and len(anchors):
        found = np.searchsorted(shared, anchors)
        hit = at[shared[np.minimum(found, len(shared) - 1)] == anchors]
    else:
        hit = np.zeros(0, np.int64)
    hit = hit[known[rows[hit]]]
    n, v = len(starts), period(window)
    near = np.zeros(n + 1, np.int32)
    np.add.at(near, np.maximum(hit - (v - 1), bounds[rows[hit]]), 1)
    np.add.at(near, hit + 1, -1)
    near = np.cumsum(near[:n]) > 0
    starts_at = np.flatnonzero(near[: max(0, n - window + 1)])
    starts_at = starts_at[rows[starts_at] == rows[starts_at + window - 1]]
    full = run_hashes(hashes, window)[starts_at]
    least = _least_doc(full, ids[rows[starts_at]])
    return (data, starts, ends, rows, bounds), starts_at, ids[rows[starts_at]], least, kind, blobs


def substring_dedup(docs: DataFrame, window: int = 50, *, unit_bytes: int = UNIT_BYTES, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans; with `texts` also kept_text.

    `spans` are the removed runs as pairs of word places [from, to). kept_sha256 is of the kept words joined by one space;
    kept_text is the text without the removed runs, its other white space unchanged. Columns in `carry` come along, row by
    row, so that no join is needed to put them back.
    """
    kinds = [docs.schema[c].dataType for c in carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    size, count = text_size(docs)
    unit_bytes = max(unit_bytes, min(64 << 20, size // 4000))
    n_units = max(1, -(-size // unit_bytes), count // 50_000)
    share = len(COVERS[period(window)]) / period(window)
    anchor_bits, window_bits = (min(int(size / 6 * part / RANGE_HASHES).bit_length(), int(unit_bytes / 6 * part / LEAST_HASHES).bit_length()) for part in (share, 1.0))
    bound_batches(docs.sparkSession)
    units = docs.withColumn("_unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_units)).cast("long"))

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *_, rows, _, _, at, found = _read(table, window)
        ids, known = _doc_ids(table)
        mine = known[rows[at]]
        hashes, least, index = _least_doc(found[mine], ids[rows[at[mine]]])
        twice = np.zeros(len(hashes), np.uint8)
        twice[index[ids[rows[at[mine]]] != least[index]]] = 1
        return pa.table(_report(key[0].as_py(), hashes, twice, anchor_bits), _REPORT)

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unit = table.column("_unit").to_pylist()
        each = [np.frombuffer(x, np.uint64) for x in table.column("_hash").to_pylist()]
        twice = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("_more").to_pylist()])
        all_ = np.concatenate(each)
        h = np.sort(all_)
        more = np.unique(np.concatenate([h[1:][h[1:] == h[:-1]], all_[twice > 0]]))
        out = [np.intersect1d(x, more, assume_unique=True) for x in each]
        rows = [(u, x.tobytes()) for u, x in zip(unit, out, strict=True) if len(x)]
        return pa.table({"_unit": [u for u, _ in rows], "_kind": [0] * len(rows), "_part": [key[0].as_py()] * len(rows), "_blob": [x for _, x in rows]}, _ANSWER)

    def reports(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _REPORT.empty_table()
        _, _, _, (hashes, least, _), _, _ = _windows(left, right, window)
        return pa.table(_report(left.column("_unit")[0].as_py(), hashes, least, window_bits), _REPORT)

    def earlier(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unit = table.column("_unit").to_pylist()
        each = [np.frombuffer(x, np.uint64) for x in table.column("_hash").to_pylist()]
        docs_ = [np.frombuffer(x, np.int64) for x in table.column("_more").to_pylist()]
        _, least, index = _least_doc(np.concatenate(each), np.concatenate(docs_))
        before = least[index] < np.concatenate(docs_)
        at = np.cumsum([0, *map(len, each)])
        blobs = [np.packbits(before[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"_unit": unit, "_kind": [1] * len(unit), "_part": [key[0].as_py()] * len(unit), "_blob": blobs}, _ANSWER)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>"
    if texts:
        fields, ddl = [*fields, ("kept_text", pa.string())], f"{ddl}, kept_text string"
    for i, kind in enumerate(kinds):
        fields, ddl = [*fields, (f"_carry{i}", to_arrow_type(kind))], f"{ddl}, _carry{i} {kind.simpleString()}"
    out_schema = pa.schema(fields)

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        (data, starts, ends, rows, bounds), at, doc, (hashes, least, index), kind, blobs = _windows(left, right, window)
        part, bits = _ranges(hashes, window_bits), np.zeros(len(hashes), bool)
        for p, k, b in zip(right.column("_part").to_pylist(), kind, blobs, strict=True):
            if k == 1:
                lo, hi = np.searchsorted(part, [p, p + 1])
                bits[lo:hi] = np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo).astype(bool)
        gone = at[bits[index] | (least[index] < doc)] if len(at) else at
        change = np.zeros(len(starts) + 1, np.int32)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        removed = np.cumsum(change[:-1]) > 0
        rows_out: dict[str, list] = {f.name: [] for f in out_schema}
        for r, text in enumerate(left.column("text").to_pylist()):
            lo, hi = bounds[r], bounds[r + 1]
            own = removed[lo:hi]
            raw = (text or "").encode()
            spans: list[list[int]] = []
            kept = raw.split()
            if own.any():
                kept = list(compress(kept, (~own).tolist()))
                edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                spans = edge.reshape(-1, 2).tolist()
            rows_out["n_words"].append(int(hi - lo))
            rows_out["n_removed"].append(int(own.sum()))
            rows_out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            rows_out["spans"].append(spans)
            if texts:
                if spans and text is not None:
                    base = int(starts[lo]) - _leading(raw)
                    keep, last = [], 0
                    for a, b in spans:
                        keep.append(raw[last : int(starts[lo + a]) - base])
                        last = int(starts[lo + b]) - base if lo + b < hi else int(ends[hi - 1]) - base
                    text = b"".join([*keep, raw[last:]]).decode()
                rows_out["kept_text"].append(text)
        rows_out["doc_id"] = left.column("doc_id").combine_chunks()
        for i, kind in enumerate(kinds):
            rows_out[f"_carry{i}"] = left.column(f"_carry{i}").combine_chunks().cast(to_arrow_type(kind))
        return pa.table(rows_out, out_schema)

    def lean(f):
        """f, which gives memory back after each group."""

        def run(*args):
            out = f(*args)
            free_memory()
            return out

        return (lambda key, table: run(key, table)) if f in (anchors, shared, earlier) else (lambda key, left, right: run(key, left, right))

    found = units.groupBy("_unit").applyInArrow(lean(anchors), _REPORT_DDL)
    answers = found.groupBy("_part").applyInArrow(lean(shared), _ANSWER_DDL)
    held = units.groupBy("_unit").cogroup(answers.groupBy("_unit")).applyInArrow(lean(reports), _REPORT_DDL)
    second = held.groupBy("_part").applyInArrow(lean(earlier), _ANSWER_DDL)
    out = units.groupBy("_unit").cogroup(answers.unionByName(second).groupBy("_unit")).applyInArrow(lean(finish), ddl)
    return out.withColumnsRenamed({f"_carry{i}": c for i, c in enumerate(carry)})


def _leading(raw: bytes) -> int:
    """Bytes before the first word."""
    return len(raw) - len(raw.lstrip())
