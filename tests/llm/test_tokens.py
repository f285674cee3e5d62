import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codeloom.llm import bpe
from codeloom.llm.bpe import Automaton, Encoder, Vocabulary, byte_letters, decode, encode
from codeloom.llm.token_counts import token_counts

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a\n b", "tab\there", "Hello, world! it's we'll '  's", "É Straße ŒUVRE œ", "日本語 テキスト 漢字", "emoji 😀😀 x", "áé NFC",
    "<s> </s> <unk> <0x0A>", "<|endoftext|>", "x<|startoftext|>Y <|ENDOFTEXT|>", "ΣΑΣ İstanbul ǅ", "½ ² 12345 ٣", "▁▁ x▁y ▁", "\x00\x1c\x85\xa0z", "foo_bar __ --- ...", "a" * 3000, "ab " * 5000, "İ", "don't DON'T 'tis", "\r\n", "x​y", "한국어 각", "!!\n!!,,", "".join(chr(97 + i * i % 26) for i in range(20_000)), "lorem" * 3000 + "é" * 500]


def texts():
    rng = random.Random(5)
    alphabet = "abcdeéè ñ.,!'\n  tshTSH0123ßàº×²日"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(i, t) for i, t in enumerate(texts())] + [(9000, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts(docs, PIECE, 100).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), t
    assert token_counts(docs.limit(0), PIECE).count() == 0


def test_encoding_equals_the_library(spark):
    lib = Tokenizer.from_file(WORD)
    rows = [(i, t) for i, t in enumerate(texts())] + [(9000, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in encode(docs, WORD, frequent=["tsh", "éè"], ids=True).collect()}
    assert len(got) == len(rows)
    vocabulary = Vocabulary(WORD)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(t)
        assert got[i].decoded == back == decode(vocabulary, ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert encode(docs.limit(0), WORD).count() == 0


def test_automaton_numbers_its_words_and_shares_suffixes():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(500)})
    flat = Automaton.build(words)
    a = Automaton(flat)
    assert [a.place(w) for w in words] == list(range(len(words)))
    assert all(a.place(w) == -1 for w in ("", "abcabcabc", "d", "abd"))
    suffixes = Automaton.build(sorted(x + "ing" for x in "abcdefgh"))
    assert suffixes[0] == 5  # the root, one state for each rest of "ing", the end


def test_words_merged_together_are_those_merged_one_by_one():
    v, rng, letters = Vocabulary(WORD), random.Random(5), byte_letters()
    words = ["".join(rng.choice(letters if i % 3 else "abetn") for _ in range(rng.randint(1, 60))) for i in range(3000)]
    words += [x * n for x in ("a", "e", "-", "=", "an", "e-") for n in range(1, 60)]
    one = [v.merge(w) for w in words]
    assert v.ordered and v.merge_all(words) == one and v.merge_all([]) == []
    v.ordered = False
    assert v.merge_all(words) == one
    shapes = Automaton(Automaton.build(sorted({"an", "and", "band", "b", "ét"})))
    asked = ["an", "", "a", "and", "bandy", "b", "ét", "é", "zz", "band"]
    assert shapes.places(asked).tolist() == [shapes.place(w) for w in asked]


@pytest.mark.parametrize("table", [3, 40, 100_000])
def test_a_piece_merges_its_unknown_words_together(monkeypatch, table):
    monkeypatch.setattr(bpe, "TABLE", table)
    v, rng = Vocabulary(WORD), random.Random(6)
    made = Encoder(WORD, v.lexicon())
    calls = []
    monkeypatch.setattr(made.vocabulary, "merge", lambda w: calls.append(w) or v.merge(w))
    new = lambda: "".join(rng.choice("qxzjkvñé") for _ in range(rng.randint(4, 12)))
    texts = [" ".join(new() for _ in range(30)) for _ in range(20)] + [None, "", "Ωδ 中文 \u00a0x ﬁ é", "a <|endoftext|> ñ <|endoftext|>", "x" * 100]
    texts += [texts[0]] + [f"a {s} Ω {s}" for s in v.special]
    lib = Tokenizer.from_file(WORD)
    got = [[int(i) for _, ids, _ in f for i in ids.split()] for f in made.encode_all(texts)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [t for f in made.encode_all(texts[-1:]) for t in f][1][2] in v.special
    assert all(len(w) > bpe.LONG for w in calls)
