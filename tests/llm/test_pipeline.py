import hashlib
import random

import corpus_pipeline as cp
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm.mixing import copies, label_domains, mix
from codeloom.llm.quality import quality
from tests_llm_brute import near_classes, passages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    common = [rng.choice(vocab) for _ in range(70)]
    rows, labels = [], []
    for i in range(260):
        if rows and rng.random() < 0.15:
            words = rng.choice(rows)[1].split()
            words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(30, 160))]
            if rng.random() < 0.3:
                words[10:10] = common
        text = " ".join(words)
        good = rng.random() < 0.8
        rows.append((i, text if good else "!! ".join(text.upper().split()), "en", "s", len(text)))
        labels.append((i, int(good), int(rng.random() < 0.05)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "stray text", "en", "s", 10)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = cp.cut(cp.classify(spark, docs, folder))
    good = {r.doc_id for r in quality(docs, labels).where("score >= 0.3").collect() if r.doc_id is not None}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good and 150 < len(good) < 240

    one = cp.cut(cp.deduplicate(spark, kept, folder))
    rows = [(d, texts[d]) for d in sorted(good)]
    least = {d for d, c in near_classes(rows).items() if d == c}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == least and len(least) < len(good)

    cleaned = cp.cut(cp.strip_passages(spark, one, folder))
    want = {d: " ".join(w) for d, w in passages([(d, texts[d]) for d in sorted(least)], 50).items()}
    got = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == columns and {d: " ".join((r.text or "").split()) for d, r in got.items()} == want
    assert any(want[d] != " ".join((texts[d] or "").split()) for d in want) and all(r.n_chars == len(r.text) for r in got.values() if r.text)

    mixed = cp.cut(cp.reweigh(spark, cleaned, folder))
    rates = {r.doc_id: r.n for r in mix(cleaned, label_domains(labels), cp.TARGETS, kept="clean").select("doc_id", copies(F.col("rate"), F.col("doc_id")).alias("n")).collect()}
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and count == {d: n for d, n in rates.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = cp.tokenise(spark, mixed, folder).collect()
    assert len(last) == sum(count.values())
    for r in last:
        ids = library.encode(got[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = cp.run(spark, folder).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_stages_take_empty_tables(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_mixing_keeps_every_clean_document_of_a_cleaner_corpus(spark, tmp_path):
    rng = random.Random(12)
    kinds = ["clean"] * 980 + ["low"] * 10 + ["toxic"] * 10
    rows, labels = [], []
    for i, kind in enumerate(kinds):
        words = [rng.choice(["river", "stone", "the", "of", "tree", "road"]) for _ in range(rng.randint(20, 60))]
        if kind == "toxic":
            words[3:6] = ["scum", "idiot", "scum"]
        text = "!! ".join(words).upper() if kind == "low" else " ".join(words).capitalize()
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    count = dict.fromkeys(range(1000), 0)
    for r in cp.reweigh(spark, docs, str(tmp_path)).collect():
        count[r.doc_id] += 1
    assert all(count[i] >= 1 for i in range(980))
    assert sum(count[i] for i in range(980, 1000)) <= 24


def test_texts_under_one_id_clashing_names_long_and_repeated_rows(spark, folder):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(6))
    a, b = (" ".join(word() for _ in range(80)) for _ in range(2))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, long), (8, long), (9, None), (None, b)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _copy string, _copies string, _text_key string")
    one = cp.cut(cp.deduplicate(spark, docs, folder))
    assert one.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in one.where("doc_id is not null").collect()) == [(1, a), (5, b), (7, long), (9, "")]
    mixed = cp.reweigh(spark, one.where("doc_id is not null"), folder)
    assert mixed.columns == docs.columns and {(r._copy, r._copies, r._text_key) for r in mixed.collect()} <= {("x", "y", "z")}
    kept = cp.classify(spark, docs, folder)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0
    assert cp.strip_passages(spark, one, folder).columns == docs.columns
