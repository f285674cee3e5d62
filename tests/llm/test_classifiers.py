import random
import zlib

import numpy as np
import pyarrow as pa

from codeloom.llm.language import BUCKETS, buckets, language, learn
from codeloom.llm.quality import NAMES, quality, statistics

WORDS = {"en": "the of and with house tree water over thing shall", "fr": "le la être eau maison avec château où ça très", "de": "der und straße über häuser nicht wasser schön zwei größe"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)) + "."


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(list(WORDS))]]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", None), (1003, prose(rng, "fr", 20_000), None), (None, "the house", "en"), (1004, "é", "fr"), (1005, "a", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = language(docs, learn(docs)).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "fr" and by[None].held_out is None
    out = [(by[i].lang_pred == lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(out) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert language(docs.limit(0), learn(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in language(docs, None).collect()} == {"und"}


def test_runs_do_not_cross_rows():
    data = np.frombuffer(b"abcabcd", np.uint8)
    b = buckets(data, np.array([0, 3, 3, 7]), 3)
    assert b[0] == b[3] and (b[[1, 2, 5, 6]] == BUCKETS).all() and b[4] != BUCKETS


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.7
        text = prose(rng, "en", rng.randint(5, 80)).capitalize()
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in text.split()), " ".join([text.split()[0]] * 40)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(2000, None), (2001, ""), (None, "the"), (2002, prose(rng, "en", 30_000))]
    labels += [(5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    truth = {i: q for i, q, _ in labels[:800]}
    held = [got[i].predicted == q for i, q in truth.items() if got[i].held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert quality(docs.limit(0), marks).count() == 0
    assert {r.score for r in quality(docs, marks.limit(0)).collect()} == {0.5}


def test_statistics_do_not_depend_on_the_batch():
    texts = ["A b. c\nA b. c", "", None, "x" * 5000, "one one one two!! | 12"]
    together = statistics(pa.array(texts))
    assert together.shape == (5, len(NAMES)) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(statistics(pa.array([t], pa.string()))[0], together[i])


def test_language_learns_from_long_and_repeated_rows(spark):
    rng = random.Random(2)
    long = [(i, prose(rng, lang, 4000), lang) for i, lang in enumerate(["en", "fr"] * 20)]
    docs = spark.createDataFrame(long + [long[2]] * 3, "doc_id long, text string, lang string")
    assert all(len(t.encode()) > 16_384 for _, t, _ in long)
    got = {r.doc_id: r.lang_pred for r in language(docs, learn(docs)).collect()}
    assert got == {i: lang for i, _, lang in long}
    for one in (1, 2, 3, 4):
        same = spark.createDataFrame([(one, prose(rng, lang, 30), lang) for lang in ["en", "fr"] * 30], "doc_id long, text string, lang string")
        model = learn(same, sample=10)
        assert zlib.crc32(str(one).encode()) % 5 == 0 or (model is not None and set(model.labels) <= {"en", "fr"})
        again = spark.createDataFrame([(one, "the house of the water", "en")] * 50, "doc_id long, text string, lang string")
        assert zlib.crc32(str(one).encode()) % 5 == 0 or learn(again, sample=5).labels == ["en"]


def test_language_scores_against_plain_python(spark):
    """The mean of the subwords' vectors, one subword at a time."""
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randint(1, 30)), lang) for i in range(200) for lang in ["en", "fr", "de"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(docs)

    def bucket(run):
        h = len(run) * 40503
        for b in run:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 19

    texts = ["the house", "ÉTÉ à Paris", "straße", "ab", "x", rows[0][1]]
    got = language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r, t in zip(sorted(got), texts, strict=True):
        raw = t.lower().encode()
        runs = [raw[i : i + n] for n in (3, 4) for i in range(len(raw) - n + 1)]
        logits = model.bias + (sum(model.scores[bucket(x)].astype(float) for x in runs) / len(runs) if runs else 0)
        e = np.exp((logits - logits.max()) / model.temperature)
        assert r.lang_pred == model.labels[int(np.argmax(e))] and abs(r.score - (e / e.sum()).max()) < 1e-6


def test_quality_scores_against_plain_numpy(spark):
    """Class moments and Gaussian log densities without Cholesky factors or map-side sums."""
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", rng.randint(5, 60)).capitalize() if i % 3 else "BUY!! " * rng.randint(3, 20)) for i in range(300)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.score) for r in quality(docs, marks).collect())
    x = statistics(pa.array([t for _, t in rows]))
    fit = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows])
    label = np.array([int(i % 3 > 0) for i, _ in rows])
    common = np.maximum(x[fit].var(axis=0), 1e-6)
    logs = []
    for c in (0, 1):
        own = x[fit & (label == c)]
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.05 * np.diag(common)
        d = x - own.mean(axis=0)
        logs.append(np.log(len(own) / fit.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 2, -60, 60)))
    assert np.allclose([s for _, s in got], [s for _, s in sorted(zip([i for i, _ in rows], want, strict=True))], atol=1e-5)
