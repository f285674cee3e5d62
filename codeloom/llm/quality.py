"""Document quality by regularised quadratic discriminant analysis over transformed document statistics.

Method. Each text gives the statistics in `NAMES` (shares of character classes, word lengths, repetition of words and
lines), put on scales on which they are near normal (logs of counts, logits of shares). Each class has a mean and a
covariance (short texts are smoothed: each share counts `PRIOR_WORDS` words of ordinary prose more) shrunk towards its own diagonal and a common spread; the score is the logistic of the difference of the two
Gaussian log densities (Mahalanobis distances through cached Cholesky factors, log determinants, class shares), divided
by a temperature.

Plan: one narrow map computes all statistics and writes them (a few dozen numbers a document) to the shared folder. The
fit joins them with the labels and sums class counts, sums and products, map-side first: a few thousand numbers reach the
driver at any input size, and every labelled row counts. Scoring is another narrow map over the numbers.

Defined results. Null text counts as empty. Labels that are null, or that contradict each other for one doc_id, are not
learned from; null doc_id is never learned from and its held_out is null. If a class has no row, every score is 0.5.
Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, cut, small_pieces, text_buffer
from codeloom.llm.language import held_out
from codeloom.llm.wordhash import lower_ascii, row_bounds, word_hashes, words

NAMES = [
    "log_words", "word_length", "word_length_spread", "upper", "digit", "exclaim", "bar", "stop_mark", "comma", "symbol", "non_ascii",
    "distinct", "top_word", "same_as_before", "distinct_pairs", "line_words", "repeated_lines", "short_words", "marked_words", "capital_words",
]
LIMIT = 0.3
#: Ordinary prose that each text is taken to hold besides its own, so that a few words are no strong evidence.
PRIOR_WORDS, PRIOR_LENGTH = 12, 5.5
_PRIOR_CHARS = (0.02, 0.0, 0.0, 0.0, 0.015, 0.015, 0.0, 0.05, 0.9)
_CLASS = np.zeros((256, 9), bool)
for _column, _bytes in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b"!", b"|", b".", b",", b"#$%&*+-/:;<=>?@\\^_~()[]{}\"'`", range(0x80, 0xC0), range(0x61, 0x7B))):
    _CLASS[list(_bytes), _column] = True


def _logit(share: np.ndarray, floor: float = 1e-3) -> np.ndarray:
    s = np.clip(share, 0, 1) * (1 - 2 * floor) + floor
    return np.log(s / (1 - s))


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, largest count of one) in each row."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    key = (rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[edge, len(key)])
    row = (key[edge] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, row, count)
    return np.bincount(row, minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(lower_ascii(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    bounds = row_bounds(rows, n)
    count = np.diff(bounds).astype(float)
    some = count + PRIOR_WORDS
    length = (ends - starts).astype(float)
    total = np.bincount(rows, length, n)
    mean = (total + PRIOR_WORDS * PRIOR_LENGTH) / some
    spread = np.sqrt(np.maximum((np.bincount(rows, length**2, n) + PRIOR_WORDS * (PRIOR_LENGTH**2 + 9)) / some - mean**2, 0))
    chars = total + PRIOR_WORDS * PRIOR_LENGTH
    classes = []
    for k in range(_CLASS.shape[1]):
        summed = np.concatenate([[0], np.cumsum(_CLASS[data, k])])
        classes.append((summed[offsets[1:]] - summed[offsets[:-1]] + PRIOR_WORDS * PRIOR_LENGTH * _PRIOR_CHARS[k]) / chars)
    upper, digit, exclaim, bar, stop, comma, symbol, non_ascii, lower = classes
    distinct, most = _distinct(rows, hashes, n)
    same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    again = np.bincount(rows[1:][same], minlength=n) / some
    pair = rows[1:] == rows[:-1]
    pairs, _ = _distinct(rows[1:][pair], (hashes[1:] * np.uint64(3) ^ (hashes[:-1] >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15))[pair], n)
    feeds = np.flatnonzero(data == 10)
    line = np.zeros(len(starts), np.int64)
    if len(starts):
        line = np.searchsorted(feeds, starts) + rows  # a row's first line differs from the last of the row before
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        lines = np.bincount(rows[first], minlength=n)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(hashes * (np.arange(len(hashes)) - np.repeat(first, np.diff(np.r_[first, len(hashes)])) + 1).astype(np.uint64), first)
        kinds, _ = _distinct(rows[first], sums, n)
    else:
        lines = kinds = np.zeros(n)
    short = (np.bincount(rows, length <= 3, n) + 0.35 * PRIOR_WORDS) / some
    last = data[ends - 1] if len(ends) else data[:0]
    marked = np.bincount(rows, _CLASS[last, 2] | _CLASS[last, 6], n) / some
    lead = data[starts] if len(starts) else data[:0]
    capital = (np.bincount(rows, _CLASS[lead, 0], n) + 0.1 * PRIOR_WORDS) / some
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(spread), _logit(upper / (upper + lower + 1e-3)), _logit(digit), _logit(exclaim), _logit(bar), _logit(stop), _logit(comma), _logit(symbol), _logit(non_ascii),
        np.log(distinct + PRIOR_WORDS) / np.log(some + 1), _logit((most + 1) / some), _logit(again), _logit((pairs + PRIOR_WORDS) / some), np.log1p(count / np.maximum(lines, 1)), _logit((lines - kinds) / (lines + 3)), _logit(short), _logit(marked), _logit(capital),
    ])


def with_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, x (the statistics) and `carry`, per row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches):
            x = statistics(batch.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), flat, *batch.columns[2:]], names=["doc_id", "x", *carry])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return arrow_map(rows, run, f"doc_id long, x array<double>{kinds}")


@dataclass
class Gaussian:
    log_share: float
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_share + np.log(np.abs(np.diag(self.factor))).sum() - 0.5 * (z**2).sum(axis=1)


@dataclass
class Model:
    classes: tuple[Gaussian, Gaussian] | None
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None or not len(x):
            return np.full(len(x), 0.5)
        gap = (self.classes[1].log_density(x) - self.classes[0].log_density(x)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))


def fit(stats: DataFrame, labels: DataFrame, *, shrink: float = 0.1, spread: float = 0.05, temperature: float = 2.0) -> Model:
    """From `stats` (doc_id, x) and `labels` (doc_id, quality): all labelled rows outside the held-out fold."""
    d = len(NAMES)
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("low"), F.max("quality").cast("int").alias("high"))
    marks = marks.where("low = high").select("doc_id", F.col("low").alias("label"))
    rows = stats.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("label", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                own = x[label == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.record_batch([np.repeat([0, 1], sums.shape[1]).astype(np.int32), np.tile(np.arange(sums.shape[1]), 2).astype(np.int32), sums.ravel()], names=["label", "at", "value"])

    got = arrow_map(rows, moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in got:
        sums[r.label, r["at"]] = r.value
    if not (sums[:, 0] > 0).all():
        return Model(None, temperature)
    out = []
    common = np.maximum((sums[:, 1 + d :].sum(axis=0).reshape(d, d) / sums[:, 0].sum() - np.outer(m := sums[:, 1 : 1 + d].sum(axis=0) / sums[:, 0].sum(), m)).diagonal(), 1e-6)
    for c in (0, 1):
        n = sums[c, 0]
        mean = sums[c, 1 : 1 + d] / n
        cov = sums[c, 1 + d :].reshape(d, d) / n - np.outer(mean, mean)
        own = np.maximum(np.diag(cov), 0)
        cov = (1 - shrink) * cov + shrink * np.diag(own) + spread * np.diag(common)
        out.append(Gaussian(float(np.log(n / sums[:, 0].sum())), mean, np.linalg.inv(np.linalg.cholesky(cov))))
    return Model((out[0], out[1]), temperature)


def score(stats: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """Per row of `stats`: doc_id, held_out, score, predicted (1 if score >= limit) and the other columns of `stats`."""
    more = [c for c in stats.columns if c not in ("doc_id", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.record_batch([batch.column(0), batch.column(2), s, (s >= limit).astype(np.int32), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *more])

    kinds = "".join(f", `{c}` {stats.schema[c].dataType.simpleString()}" for c in more)
    rows = stats.select("doc_id", "x", held_out(F.col("doc_id")).alias("held_out"), *more)
    return arrow_map(rows, run, f"doc_id long, held_out boolean, score double, predicted int{kinds}")


def quality(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fits on the labelled rows of `docs` outside the held-out fold and scores every row; columns in `carry` come along."""
    stats = cut(with_statistics(docs, carry), like="statistics")
    return score(stats, fit(stats, labels), limit)
