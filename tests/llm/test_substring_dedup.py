import hashlib
import random
import re

from codeloom.llm.substring_dedup import COVERS, substring_dedup


def brute(rows, window):
    seen = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and seen[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
            words += rng.choice(passages)
        rows.append((d * 7 % 61, rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, "a " * 300), (102, "a " * 120), (103, None), (104, ""), (None, rows[3][1]), (105, "x" * 50_000), (106, " ".join(["no", "break"]) + "\x85x")]
    return rows


def test_covers_hold_every_difference():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_equals_brute_force(spark):
    for seed, unit in ((1, 1 << 22), (2, 4000)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_words string, _unit int")
        got = substring_dedup(docs, 50, unit_bytes=unit, texts=True, carry=("_unit",)).collect()
        assert {r["_unit"] for r in got} == {1}
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 50)
        for r in got:
            assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.kept_text or "")).encode()).hexdigest() == r.kept_sha256
            assert sum(b - a for a, b in r.spans) == r.n_removed


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
