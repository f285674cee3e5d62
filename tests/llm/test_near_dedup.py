import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import near_dedup
from codeloom.llm.common import only
from codeloom.llm.components import components
from codeloom.llm.near_dedup import CHUNKS, DISTANCE, PLACES, Bitmaps, keys, near_duplicates, sets


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and (n := len(sets[i] & sets[j])) and 100 * n >= 75 * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), None if d is None else least[top(i)], d is None or least[top(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    rows, d = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 40, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((d, (" ".join(copy)).upper() if rng.random() < 0.2 else "\n".join(copy)))
            d += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (None, rows[0][1]), (9004, "É " * 3000), (9005, "é " * 3000), rows[1], rows[2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_texts_without_partners_are_not_moved(spark, no_broadcast):
    rng = random.Random(3)
    rows = [(d, " ".join(f"{rng.getrandbits(24):x}" for _ in range(700))) for d in range(1200)]
    rows += [(2000 + d, f"{t} more") for d, t in rows[:12]]
    store, nothing = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, nothing, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = max(stages(), default=-1)
    kept = {r.doc_id for r in near_duplicates(docs).where("kept").collect()}
    assert kept == set(range(1200))
    assert sum(n for k, n in stages().items() if k > before) < 0.4 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_filter_of_keys_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr("codeloom.llm.common.FILTER_BITS", bits)
    rows = spark.range(-2000, 2000).selectExpr("id as a", "id % 7 as b")
    wanted = spark.range(-2000, 2000, 40).selectExpr("id as x", "id % 7 as y")
    left = {r.a for r in only(rows, ["a", "b"], wanted, ["x", "y"]).collect()}
    assert left >= set(range(-2000, 2000, 40))
    assert bits == 64 or len(left) < 1000
    assert only(rows, ["a"], rows.where("false")).count() == 0


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    assert sum(e + 1 for _, e in CHUNKS) > DISTANCE and sum(n for n, _ in CHUNKS) == PLACES
    a = rng.integers(0, 1 << 16, (2000, PLACES), dtype=np.uint16)
    b = a.copy()
    for x in b:
        at = rng.choice(PLACES, DISTANCE, replace=False)
        x[at] ^= 1
    assert (keys(a) == keys(b)).any(axis=1).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 160)] + [(7, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 61), 10), **dict.fromkeys(range(100, 160), 100), 5: 5, 7: 5}


def test_links_at_the_limit_are_found(spark):
    """Pairs at exactly 0.75: 60 shared shingles of 80."""
    rows = []
    for i in range(400):
        for k in "ab":
            rows.append((2 * i + (k == "b"), " ".join([f"w{i}.{j}" for j in range(64)] + [f"{k}{i}.{j}" for j in range(10)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert all(got[2 * i] == 2 * i for i in range(400))
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) >= 398  # 0.9999 of them by the signature distance


def test_bitmaps_bound_the_intersection_from_above():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.sample(words, n)) for n in (5, 9, 17, 40, 90, 180, 400)]
    for t in list(texts):
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        texts += [" ".join(w), " ".join(w[: max(1, len(w) * 3 // 4)])]
    row, count, _, _, bits = sets(pa.array(texts))
    assert row.tolist() == list(range(len(texts)))
    bitmaps = Bitmaps(pa.array(bits, pa.binary()))
    full = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} or {tuple(t.split())} for t in texts]
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if 100 * min(count[i], count[j]) >= 75 * max(count[i], count[j])]
    x, y = np.array(pairs).T
    most = bitmaps.most(x, y, count[x], count[y])
    assert all(m >= len(full[i] & full[j]) for (i, j), m in zip(pairs, most, strict=True))
    assert np.mean([m < 0.5 * count[i] for (i, j), m in zip(pairs, most, strict=True) if not full[i] & full[j]]) > 0.8


def test_a_large_group_of_near_but_different_texts(spark, monkeypatch):
    """Blocks with rows and columns: one passage that all share, links only within families."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for family in range(25):
        own = [f"f{family}.{i}" for i in range(30)]
        for _ in range(rng.randint(1, 4)):
            w = shared + own
            w[rng.randrange(60, 90)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, rows[0][1]), (1, rows[5][1]), (1, rows[5][1]), (1, rows[-1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
