"""Language identification by averaged hashed subword embeddings and a linear softmax.

Method. A text's subwords are its runs of 3 and of 4 UTF-8 bytes after lower-casing, so that they see word edges; each is
hashed to one of `BUCKETS` rows of an embedding matrix. The mean of a text's rows goes through a linear softmax. Both
matrices are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows. A temperature
is fitted on a part of the sample kept aside, and the least calibrated probability at which predictions there are right
99 times of 100 becomes the limit below which a prediction is rejected (column `accepted`).

Since the softmax is linear in the mean, a text's logits are the mean of one small vector for each bucket: prediction is
one gather and one segmented sum over the bytes of a batch, without a Python object for a word.

Plan: a count and one filtered scan for the sample (about `SAMPLE` labelled rows with a letter, of least hash of id, text
and language; rows that repeat count once; a longer text gives its first `SAMPLE_CHARS` characters), training on the
driver, then one narrow map over whole texts.

Defined results. Null text or text without a letter: `und`, score 0, not accepted. Without a labelled row that
has a letter every prediction is `und`. Rows with null doc_id are never learned from; held_out is then null. Ties go to the language that
sorts first. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, hashed_sample, small_pieces, text_buffer

BUCKETS, DIMENSIONS = 1 << 13, 8
SAMPLE, SAMPLE_CHARS = 4000, 16_384
ORDERS = (3, 4)
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id's decimal text leaves 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def buckets(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the run that begins at each byte; BUCKETS where the row ends before the run does."""
    n = len(data)
    h = np.full(n, np.uint32(order * 40503), np.uint32)
    wide = data.astype(np.uint32)
    for k in range(order):
        m = max(n - k, 0)
        h[:m] = (h[:m] ^ wide[k:]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    out = (h >> np.uint32(32 - 13)).astype(np.int32)
    for k in range(1, order):
        ends = offsets[1:] - k
        out[ends[ends >= offsets[:-1]]] = BUCKETS
    return out


def lowered(column: pa.Array) -> pa.Array:
    return pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.large_string())


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` in each segment; empty segments give 0."""
    out = np.zeros((len(offsets) - 1, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # bucket x language, last row 0
    bias: np.ndarray
    temperature: float
    limit: float

    def logits(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(lowered(column))
        total = np.zeros((len(offsets) - 1, len(self.labels)))
        n = np.zeros(len(offsets) - 1)
        for order in ORDERS:
            total += segment_sums(self.scores[buckets(data, offsets, order)], offsets) if len(data) else 0
            n += np.maximum(np.diff(offsets) - order + 1, 0)
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return softmax(self.logits(column) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], *, epochs: int = 12, rate: float = 40.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on embeddings and softmax; every fifth row calibrates."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs])
    data, offsets = text_buffer(lowered(pa.array(texts, pa.large_string())))
    x = np.zeros((len(texts), BUCKETS), np.float32)
    found = [buckets(data, offsets, order) for order in ORDERS]
    for i in range(len(texts)):
        seen = np.concatenate([b[offsets[i] : offsets[i + 1]] for b in found])
        seen = seen[seen < BUCKETS]
        if len(seen):
            x[i] = np.bincount(seen, minlength=BUCKETS) / len(seen)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    if len(texts) < 20:
        aside[:] = False
    fit = np.flatnonzero(~aside)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            hidden = x[at] @ emb
            p = softmax(hidden @ out + bias)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ out.T
            out -= 0.02 * step * hidden.T @ p
            bias -= 0.002 * step * p.sum(axis=0)
            emb -= step * x[at].T @ back
    scores = np.vstack([emb @ out, np.zeros((1, len(labels)), np.float32)]).astype(np.float32)
    check = np.flatnonzero(aside) if aside.any() else fit
    z = x[check] @ scores[:-1] + bias
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = softmax(z / heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-best)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99
    limit = float(best[order[np.flatnonzero(good)[-1]]]) if good.any() else 1.0
    return Model(labels, scores, bias.astype(np.float64), heat, limit)


def learn(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Trains on `docs` (doc_id, text, lang): about `sample` labelled rows of least hash outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    total = rows.select("doc_id", "lang").count()
    short = F.substring("text", 1, sample_chars).alias("text")
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    few = hashed_sample(rows, ["doc_id", "text", "lang"], sample, total).select("doc_id", short, "lang").distinct()
    got = few.collect()
    if not got and total:  # a few rows, or one many times: those of least hash
        got = rows.select("doc_id", short, "lang", F.xxhash64("doc_id", "text", "lang").alias("h")).distinct().orderBy("h", "doc_id").limit(sample).collect()
    got.sort(key=lambda r: (r.doc_id, r.text, r.lang))
    return train([r.text for r in got], [r.lang for r in got]) if got else None


def language(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score (calibrated), accepted."""
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches):
            column = batch.column(1)
            known = [model is not None and bool(t and _LETTER.search(t)) for t in column.to_pylist()]
            p = model.probabilities(column) if model else np.zeros((batch.num_rows, 1))
            best = p.argmax(axis=1)
            top = np.where(known, p[np.arange(len(p)), best], 0.0)
            names = [model.labels[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            sure = [bool(k and s >= model.limit) for s, k in zip(top, known, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), names, top, sure], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
