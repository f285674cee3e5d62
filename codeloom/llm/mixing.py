"""Mixing documents to target domain weights by soft membership. DataFrame functions only; no Python runs on executors.

Method. A labelled table names the domain of some documents. On a bounded sample of it (about `SAMPLE` labels of least hash) a
softmax regression with a ridge is fitted on a few text statistics, their squares, and the words, hashed to `BUCKETS`
features, of which all count whose log odds between a domain and the rest are `SIGNIFICANT` standard errors from 0. Every document gets posteriors p_d over domains. Nonnegative rates r_d are then fitted so that
the expected tokens of each domain, sum of r_d * tokens_d * p_dk, match the targets, by projected gradient descent on

    1/2 e' W e  +  ridge/2 sum_d t_d / T (r_d - 1)^2,   r_d >= 0,   e_k = (sum_d r_d t_d p_dk) / T - target_k

with t tokens and T their sum. The metric W is the inverse of sum t_d / T p_d p_d' over the documents whose rate is above
0, which makes every direction of e equally steep; a step that does not come nearer is halved. The ridge keeps rates near 1.
A caller may name a domain to be `kept`: the others' targets are then never above the shares these domains have, the rest is
that domain's, and documents whose likeliest domain it is have a rate of at least 1: mixing never drops them.

Plan. One narrow pass over the texts writes a few numbers a document to the shared folder. A gradient needs the K domain
residuals only, and a document's rate is a function of its posteriors and of the residuals so far, so each step is one
map-side aggregate over those numbers whose K sums reach the driver; no per-document state is kept between steps.

Defined results. Null text counts as empty: no tokens, a rate like any other. Labels that are null are ignored, and of
several domains for one doc_id the least name counts. Domains without labels in the sample have posterior 0 everywhere;
targets of domains without mass are spread over the others. Without any label all rates are 1 and posteriors null.
Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, hashed_sample

SAMPLE = 4000
BUCKETS = 1 << 13
SIGNIFICANT = 3.0
STEPS, RIDGE, CLOSE = 25, 1e-3, 1e-4
_MARKS = "!|#$%&*"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STATS = ["log_words", "word_length", "distinct", "marks", "upper"]


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of a table with quality and toxic marks: toxic before low before clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


def _measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, d (buckets of the words, distinct), tokens, the statistics and `carry`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), *carry)
    rows = rows.withColumn("w", F.split(F.translate("t", "\t\n\x0b\x0c\r", "     "), " "))
    rows = rows.withColumn("w", F.filter("w", lambda x: x != "")).withColumn("tokens", F.size("w").cast("long"))
    rows = rows.withColumn("d", F.array_distinct(F.transform("w", lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(BUCKETS)).cast("int"))))
    n, length = F.greatest(F.col("tokens"), F.lit(1)), F.greatest(F.length("t"), F.lit(1))
    return rows.select(
        "doc_id", "d", "tokens", *carry,
        F.log1p("tokens").alias("log_words"),
        F.log1p(F.greatest((F.length("t") - F.col("tokens") + 1) / n, F.lit(0))).alias("word_length"),
        (F.log(F.size("d") + F.lit(10)) / F.log(n + F.lit(10))).alias("distinct"),
        F.log(0.002 + (F.length("t") - F.length(F.translate("t", _MARKS, ""))) / (length + F.lit(40))).alias("marks"),
        F.log(0.01 + (F.length("t") - F.length(F.translate("t", _UPPER, ""))) / (length + F.lit(40))).alias("upper"),
    )


@dataclass
class Classifier:
    domains: list[str]
    mean: list[float]  # of each statistic
    spread: list[float]
    linear: list[list[float]]  # by domain and statistic
    square: list[list[float]]
    words: list[list[float]]  # by domain and bucket
    bias: list[float]

    def logs(self) -> Column:
        """array<double>: the logits of the domains, over a row of _measured."""
        z = [F.greatest(F.least((F.col(s) - F.lit(m)) / F.lit(w), F.lit(4.0)), F.lit(-4.0)) for s, m, w in zip(_STATS, self.mean, self.spread, strict=True)]
        out = []
        for c in range(len(self.domains)):
            x = F.lit(self.bias[c])
            for i, y in enumerate(z):
                x = x + F.lit(self.linear[c][i]) * y + F.lit(self.square[c][i]) * y * y
            out.append(x + _weighed(F.from_json(F.lit(json.dumps(self.words[c])), "array<double>")))
        return F.array(*out)


def _weighed(weights: Column) -> Column:
    """The sum of a row's buckets' weights."""
    return F.aggregate("d", F.lit(0.0), lambda total, at: total + F.get(weights, at))


def learn(docs: DataFrame, domains: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fits on the documents of about `sample` labels (doc_id, domain) of least hash."""
    marked = domains.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    few = cut(hashed_sample(marked, "doc_id", sample, marked.count()), like="labels")
    rows = cut(_measured(docs.join(F.broadcast(few), "doc_id", "left_semi")).join(F.broadcast(few), "doc_id"), like="sample")  # `few` has about `sample` rows
    got = rows.select("domain", "d", *_STATS).collect()  # about `sample` rows
    return train([r.domain for r in got], [r.d for r in got], np.array([[r[s] for s in _STATS] for r in got])) if got else None


def train(domains: list[str], buckets: list[list[int]], stats: np.ndarray, *, ridge: float = 2e-3, rounds: int = 400) -> Classifier:
    """Softmax regression by accelerated gradient descent on the rows' statistics, squares and telling buckets."""
    names = sorted(set(domains))
    k, n = len(names), len(domains)
    y = np.array([names.index(d) for d in domains])
    at = np.concatenate([np.asarray(b, np.int64) for b in buckets])
    row = np.repeat(np.arange(n), [len(b) for b in buckets])
    have = np.zeros((k, BUCKETS))
    np.add.at(have, (y[row], at), 1)
    size = np.bincount(y, minlength=k)[:, None].astype(float)
    inside, outside = have + 0.5, have.sum(axis=0) - have + 0.5
    lacks, lacking = size - have + 0.5, (n - size) - (have.sum(axis=0) - have) + 0.5
    odds = np.log(inside * lacking / (outside * lacks)) / np.sqrt(1 / inside + 1 / outside + 1 / lacks + 1 / lacking)
    used = np.flatnonzero((np.abs(odds) >= SIGNIFICANT).any(axis=0))
    mean, spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 0.05)
    z = np.clip((stats - mean) / spread, -4, 4)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    x = np.zeros((n, len(used) + 2 * stats.shape[1] + 1), np.float32)
    x[row[place[at] >= 0], place[at][place[at] >= 0]] = 1
    x[:, len(used) : -1], x[:, -1] = np.hstack([z, z * z]), 1
    truth = np.eye(k, dtype=np.float32)[y]
    top = 0.25 * float(np.linalg.norm(x, 2)) ** 2 / n + ridge
    w = ahead = np.zeros((x.shape[1], k), np.float32)
    for i in range(rounds):
        p = x @ ahead
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - (x.T @ (p - truth) / n + ridge * ahead) / (2 * top)
        ahead, w = new + i / (i + 3) * (new - w), new
    words = np.zeros((k, BUCKETS))
    words[:, used] = w[: len(used)].T
    mine = w[len(used) : -1].T.astype(float)
    d = stats.shape[1]
    return Classifier(names, mean.tolist(), spread.tolist(), mine[:, :d].tolist(), mine[:, d:].tolist(), words.round(6).tolist(), w[-1].astype(float).tolist())


def memberships(docs: DataFrame, model: Classifier, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tokens, p (posteriors, in the order of model.domains) and `carry`."""
    rows = _measured(docs, carry).select("doc_id", "tokens", *carry, model.logs().alias("z"))
    e = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    rows = rows.select("doc_id", "tokens", *carry, e.alias("e"))
    return rows.select("doc_id", "tokens", *carry, F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def _rate(history: list[list[float]], ridge: float, floor: Column) -> Column:
    """The rate after the projected steps in `history` (each the negative change per unit of posterior), from rate 1, never below `floor`."""
    if not history:
        return F.lit(1.0)
    steps = F.from_json(F.lit(json.dumps(history)), "array<array<double>>")

    def move(r: Column, u: Column) -> Column:
        slope = F.aggregate(F.zip_with("p", u, lambda x, y: x * y), F.lit(0.0), lambda a, y: a + y)
        return F.greatest(floor, r - slope - F.lit(ridge / (1 + ridge)) * (r - 1))

    return F.aggregate(steps, F.lit(1.0), move)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], *, steps: int = STEPS, ridge: float = RIDGE, close: float = CLOSE, kept: str | None = None) -> DataFrame:
    """`members` with `rate`. Targets are shares of the tokens there are.

    With `kept`, targets of other domains are at most their shares, that one's is the rest, and its likeliest documents
    have a rate of at least 1.
    """
    k = len(domains)
    floor: Column = F.lit(0.0)
    if kept in domains:
        floor = F.when(F.array_position("p", F.array_max("p")) == domains.index(kept) + 1, 1.0).otherwise(0.0)
    each = [F.get("p", F.lit(i)) for i in range(k)]
    sums = [F.sum(F.col("r") * F.col("tokens") * x) for x in each]
    sums += [F.sum(F.when(F.col("r") > 0, F.col("tokens")) * x * y) for x in each for y in each]

    def state(history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' tokens at these rates, and the products of posteriors over the documents that count."""
        row = members.select("tokens", "p", _rate(history, ridge, floor).alias("r")).agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
        got = np.array([float(x or 0.0) for x in row])
        return got[:k], got[k:].reshape(k, k)

    now, gram = state([])
    total = float(now.sum())
    if total <= 0:
        return members.withColumn("rate", F.lit(1.0))
    want = np.array([targets.get(d, 0.0) if x / total > 1e-9 else 0.0 for d, x in zip(domains, now, strict=True)])
    if kept in domains and now[domains.index(kept)] / total > 1e-9:
        want = np.minimum(want, now / total)
        want[domains.index(kept)] += 1 - want.sum()
    if not want.sum():
        return members.withColumn("rate", F.lit(1.0))
    want /= want.sum()
    history: list[list[float]] = []
    off, scale = now / total - want, 1.0
    for _ in range(steps):
        if np.abs(off).max() < close or scale < 0.01:
            break
        move = scale * np.linalg.pinv(gram / total, rcond=1e-9, hermitian=True) @ off / (1 + ridge)
        now, next_gram = state([*history, move.tolist()])
        if (gap := now / total - want) @ gap < off @ off:
            history.append(move.tolist())
            off, gram, scale = gap, next_gram, min(1.0, 2 * scale)
        else:
            scale /= 2
    return members.withColumn("rate", _rate(history, ridge, floor))


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], *, kept: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, tokens, posteriors map<domain, double>, rate; columns in `carry` come along."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    model = learn(docs, domains)
    if model is None:
        return _measured(docs, carry).select("doc_id", "tokens", *carry, F.lit(None).cast("map<string,double>").alias("posteriors"), F.lit(1.0).alias("rate"))
    members = cut(memberships(docs, model, carry), like="members")
    rated = fit_rates(members, model.domains, targets, kept=kept)
    return rated.select("doc_id", "tokens", *carry, F.map_from_arrays(F.array(*map(F.lit, model.domains)), "p").alias("posteriors"), "rate")


def copies(rate: Column, key: Column) -> Column:
    """How often a row is taken at this rate: its whole part, and one more where the key's hash says so."""
    spin = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rate + 1e-9)
    return (whole + F.when(spin < rate - whole, 1).otherwise(0)).cast("int")
