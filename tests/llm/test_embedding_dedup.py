import numpy as np
import pytest

from codeloom.llm import embedding_dedup
from codeloom.llm.embedding_dedup import chunks, encode, near_vectors, quantiser, table_keys

SCHEMA = "vec_id long, embedding array<float>, n int"


def brute(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    ids = [i for i, _ in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for p in range(len(rows)):
        for q in range(len(rows)):
            if p != q and ok[p] and ok[q] and len(rows[p][1]) == len(rows[q][1]):
                x, y = (np.asarray(rows[k][1], np.float32).astype(float) for k in (p, q))
                near[p, q] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9
    reach = near | np.eye(len(rows), dtype=bool)
    while (more := (reach.astype(int) @ reach.astype(int)) > 0).sum() > reach.sum():
        reach = more
    least = [min(ids[q] for q in np.flatnonzero(r)) for r in reach]
    return sorted((i, int(k.sum()), c, i == c) for i, k, c in zip(ids, near, least, strict=True))


@pytest.mark.parametrize("d", [64, 12])
def test_against_brute_force(spark, d, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(d)
    base = rng.normal(size=(150, d))
    rows = []
    for x in base:
        for _ in range(rng.integers(1, 5)):
            rows.append((len(rows) * 3, (x + rng.normal(size=d) * rng.choice([0, 0.05, 0.2]) * 1.0).astype(np.float32).tolist()))
    rows += [(5000 + i, rows[4][1]) for i in range(30)] + [(6000 + i, (np.array(rows[9][1]) + rng.normal(size=d) * 0.02).astype(np.float32).tolist()) for i in range(40)]
    rows += [(7000, None), (7001, [0.0] * d), (7002, [float("nan")] * d), (7003, [None] * d), (7004, []), (7005, rows[0][1][:-1]), (7006, (np.array(rows[0][1][:-1]) * 2).tolist())]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)).collect())
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.9


def test_recall_at_the_limit_itself():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    width, count = chunks(50_000, 0.9)
    projection, t = quantiser(x, -(-count // (64 // width)))
    a, b = (table_keys(encode(z, projection, t), width, count) for z in (x, y))
    met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    assert met > 0.95
    assert 0.45 < encode(x, projection, t).mean() < 0.55


def test_recall_with_a_strong_common_direction(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1000, 64))
    x[:, 0] += 13.0  # any two at a cosine near 0.73
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(axis=1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    v = np.concatenate([x, y])
    near = (v @ v.T >= 0.9).sum() - len(v)
    rows = [(i, z.tolist(), 1) for i, z in enumerate(v)]
    got = sum(r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect())
    assert 2000 <= near and 0.96 * near <= got <= near


def test_empty_and_tiny(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], SCHEMA)).collect()
    assert sorted((r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True)]
