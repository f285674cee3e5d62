"""Encoding and decoding with a word-end byte-pair vocabulary, through a minimal acyclic transducer of frequent words.

Method. Frequent words are compiled with their ids into one shared-suffix automaton: states with equal futures are one
state, and each edge carries the number of words that sort before it, so that walking a word gives its place in the
lexicon and thereby its ids. The automaton is four flat integer arrays in one file that Spark hands to each executor and
every worker memory-maps. Merges were learned by frequency, so by default the frequent words are the vocabulary's own
whole words, which bounds the file by the vocabulary; a caller may add a corpus's words. A word that the lexicon lacks is
merged exactly: lowest rank first, leftmost first. The distinct unknown words of a piece of texts are walked and merged
together in numpy, a round for each word's next merge; that is the same as one by one if each token's merges come before
those that use it, which is checked (else, and for long words, each is merged by itself). What either gives is memoised in
a bounded table per worker.

Decoding joins the tokens' strings, which is what the vocabulary file's missing decoder means.

Plan: one narrow map over the documents; nothing is shuffled.

Defined results. Null text counts as empty: no ids, empty strings. The two special strings inside a text become their ids,
as the library has it; no marks are added. Whole texts, never cut; repeated rows stay; extra columns are not in the
result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, shared_dir, small_pieces

#: Entries of a worker's table of encoded words, which has an old half as large.
TABLE = 100_000
#: Letters of a word beyond which a queue finds the next merge.
LONG = 48
#: Letters from which on a word is not kept in the table.
KEPT = 64
END = "</w>"

# Texts of these characters alone need no Unicode normalisation, and lower() agrees with the library's.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿŒœ]*")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\t\n\x0b\x0c\r 0-9a-zß-öø-ÿœ]+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


class Automaton:
    """A minimal acyclic automaton over strings in four integer arrays.

    first[s]..first[s+1] are the edges of state s; an edge has a label (code point), a target (twice the state, plus 1 if
    a word ends there) and `before`, the number of words of that state that sort before the edge's.
    """

    def __init__(self, flat: np.ndarray) -> None:
        states, edges, self.root = (int(x) for x in flat[:3])
        at = np.cumsum([3, states + 1, edges, edges, edges])
        # memory views of the mapped file: reading one number makes no array
        self.first, self.label, self.target, self.before = (memoryview(flat[a:b]) for a, b in zip(at, at[1:], strict=False))
        self.rest = flat[at[-1] :]

    def place(self, word: str) -> int:
        """The word's place among the sorted words, or -1."""
        state, at, final = self.root, 0, 0
        first, label, target, before = self.first, self.label, self.target, self.before
        for c in map(ord, word):
            hi = first[state + 1]
            e = bisect_left(label, c, first[state], hi)
            if e == hi or label[e] != c:
                return -1
            at += before[e] + final
            t = target[e]
            state, final = t >> 1, t & 1
        return at if final else -1

    def places(self, words: list[str]) -> np.ndarray:
        """place() of many words at once, letter by letter."""
        if not hasattr(self, "steps"):
            first, label = np.asarray(self.first, np.int64), np.asarray(self.label, np.int64)
            self.steps = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 21 | label, np.asarray(self.target, np.int64), np.asarray(self.before, np.int64)
        step, target, before = self.steps
        length = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        out = np.full(len(words), -1)
        if not len(step):
            return out
        own, begin = np.flatnonzero(length), np.cumsum(length) - length
        state, at, final = (np.full(len(own), x, np.int64) for x in (self.root, 0, 0))
        k = 0
        while len(own):
            key = state << 21 | letters[begin[own] + k]
            e = np.minimum(np.searchsorted(step, key), len(step) - 1)
            there = step[e] == key
            own, e, at, final = own[there], e[there], at[there], final[there]
            at = at + before[e] + final
            state, final = target[e] >> 1, target[e] & 1
            k += 1
            over = length[own] == k
            out[own[over & (final == 1)]] = at[over & (final == 1)]
            own, state, at, final = (x[~over] for x in (own, state, at, final))
        return out

    @staticmethod
    def build(words: Iterable[str]) -> np.ndarray:
        """From sorted distinct words. Finished states are looked up by their edges, so equal suffixes are shared."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        sizes: list[int] = []

        def close(edges: list) -> int:
            key = tuple(edges)
            if key not in known:
                known[key] = len(states)
                states.append(key)
                sizes.append(sum((t & 1) + sizes[t >> 1] for _, t in key))
            return known[key]

        path: list[tuple[str, bool, list]] = [("", False, [])]
        for word in words:
            common = len(os.path.commonprefix([word, "".join(c for c, _, _ in path[1:])]))
            while len(path) > common + 1:
                c, final, edges = path.pop()
                path[-1][2].append((ord(c), 2 * close(edges) + final))
            path += [(c, i == len(word) - 1, []) for i, c in enumerate(word) if i >= common]
        while len(path) > 1:
            c, final, edges = path.pop()
            path[-1][2].append((ord(c), 2 * close(edges) + final))
        root = close(path[0][2])
        first = np.cumsum([0, *map(len, states)])
        label = [c for s in states for c, _ in s]
        target = [t for s in states for _, t in s]
        before = []
        for s in states:
            n = 0
            for _, t in s:
                before.append(n)
                n += (t & 1) + sizes[t >> 1]
        return np.concatenate([np.array([len(states), len(label), root]), first, label, target, before]).astype(np.int32)


class Vocabulary:
    """The vocabulary file: ids, merge ranks, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or file["decoder"] or file["post_processor"]:
            raise ValueError("this operator takes byte-pair vocabularies with word ends and without decoder")
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        made = {a + b: i for (a, b), i in self.rank.items()}
        #: Whether each token's merges all come before those that use it, so that no merge of a pair can outrank a pair of the same kind.
        self.ordered = all(i > made.get(a, -1) and i > made.get(b, -1) for (a, b), i in self.rank.items())

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mergeable pairs as sorted numbers (left id above right id), their ranks and what they become."""
        rows = np.array([(self.ids[a] << 32 | self.ids[b], i, self.ids[a + b]) for (a, b), i in self.rank.items()], np.int64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0])]
        return tuple(np.ascontiguousarray(c) for c in (*rows.T,))

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """merge() of many words at once: each round merges every word's pair of lowest rank, at all its places from the left."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG] if self.ordered else []
        out: list[list[int]] = [[]] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG or not self.ordered:
                out[i] = self.merge(w)
        if not short:
            return out
        pair, rank_of, become = self.pairs
        none = len(self.rank)
        length = np.array([len(words[i]) for i in short])
        first = np.array([self.ids.get(chr(c), -1) for c in range(512)])
        last = np.array([self.ids.get(chr(c) + END, -1) for c in range(512)])
        letters = np.frombuffer("".join([words[i] for i in short]).encode("utf-16-le"), np.uint16)
        token, end = first[letters], np.zeros(len(letters), bool)
        end[np.cumsum(length) - 1] = True
        token[end] = last[letters[end]]
        if (token < 0).any():
            raise KeyError("a letter that the vocabulary lacks")
        word = np.repeat(np.arange(len(short)), length)

        def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The rank of each pair, and what it becomes."""
            key = left << 32 | right
            at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            there = pair[at] == key
            return np.where(there, rank_of[at], none), become[at]

        def ranked(at: np.ndarray, rank: np.ndarray, new: np.ndarray) -> None:
            rank[at], new[at] = look(token[at], token[at + 1])

        rank, new = np.full(len(token), none), np.zeros(len(token), np.int64)
        ranked(np.flatnonzero(~end), rank, new)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            begin = np.flatnonzero(np.r_[True, end[:-1]])
            count = np.diff(np.r_[begin, len(token)])
            best = np.minimum.reduceat(rank, begin)
            if (best == none).any():  # words that are ready leave
                ready = np.repeat(best == none, count)
                done.append((word[ready], token[ready]))
                token, word, end, rank, new = (x[~ready] for x in (token, word, end, rank, new))
                count, best = count[best < none], best[best < none]
                if not len(token):
                    break
            hit = rank == np.repeat(best, count)
            if (hit[1:] & hit[:-1]).any():  # runs of one letter: every other place, from the left
                at = np.flatnonzero(hit)
                run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                off = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                hit[at[off % 2 == 1]] = False
            at = np.flatnonzero(hit)
            token[at], end[at] = new[at], end[at + 1]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            token, word, end, rank, new = (x[keep] for x in (token, word, end, rank, new))
            rank[at[end[at]]] = none
            before = at[at > 0] - 1
            changed = np.concatenate([at[~end[at]], before[~end[before]]])
            ranked(changed, rank, new)
        word, token = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        flat, bounds = token[order].tolist(), np.searchsorted(word[order], np.arange(len(short) + 1)).tolist()
        for k, i in enumerate(short):
            out[i] = flat[bounds[k] : bounds[k + 1]]
        return out

    def merge(self, letters: str) -> list[int]:
        """The ids of one word in byte letters, by the exact merges."""
        part = [*letters[:-1], letters[-1] + END]
        get, none = self.rank.get, len(self.rank)
        if len(part) > LONG:
            return self._merge_long(part)
        ranks = [get(p, none) for p in zip(part, part[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            a, b = part[i], part[i + 1]
            joined = a + b
            while True:  # every place of the pair, from the left
                part[i : i + 2] = [joined]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((part[i - 1], joined), none)
                if i < len(ranks):
                    ranks[i] = get((joined, part[i + 1]), none)
                try:
                    i = ranks.index(best, i + 1 if i < len(ranks) and ranks[i] == best else i)
                except ValueError:
                    break
        return [self.ids[p] for p in part]

    def _merge_long(self, part: list[str]) -> list[int]:
        """The same merges with a queue of pairs (lowest rank first, then leftmost), O(n log n)."""
        n, get = len(part), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            right[j], right[i] = -1, right[j]
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0:
                    left[y] = x
                    if (r := get((part[x], part[y]))) is not None:
                        heapq.heappush(queue, (r, x, part[x], part[y]))
        return [self.ids[p] for p in part if p]

    def lexicon(self, more: Iterable[str] = ()) -> np.ndarray:
        """The automaton of frequent words with their ids behind it: offsets, then ids, by the words' sorted place."""
        words = {t.removesuffix(END) for t in self.ids if t.endswith(END) and t != END}
        words |= {"".join(_LETTERS[b] for b in w.encode()) for w in more if w}
        ordered = sorted(words)
        ids = [self.merge(w) for w in ordered]
        return np.concatenate([Automaton.build(ordered), np.cumsum([0, *map(len, ids)]), [i for x in ids for i in x], [len(ordered)]]).astype(np.int32)


class Encoder(dict):
    """word -> (number of ids, ids as text, tokens as text); fills itself from the lexicon, else by merging.

    When full, the table becomes the old one, and what is still asked for is taken over from it: frequent words stay.
    """

    def __init__(self, path: str, lexicon: np.ndarray) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.path, self.vocabulary = path, Vocabulary(path)
        self.old: dict[str, tuple[int, str, str]] = {}
        self.words = Automaton(lexicon)
        n = int(lexicon[-1])
        self.offset, self.out = self.words.rest[: n + 1], self.words.rest[n + 1 : -1]
        library = Tokenizer.from_file(path)
        self.token = self.vocabulary.tokens
        self.number = {i: str(i) for i in self.token}
        self.normalise, self.divide = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def _found(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.number[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def words_of(self, letters: list[str]) -> list[tuple[int, str, str]]:
        """What each word in byte letters becomes: from the lexicon, and those that it lacks by merging."""
        place = self.words.places(letters)
        out: list[list[int]] = [self.out[self.offset[p] : self.offset[p + 1]].tolist() if p >= 0 else [] for p in place.tolist()]
        rest = np.flatnonzero(place < 0).tolist()
        for i, ids in zip(rest, self.vocabulary.merge_all([letters[i] for i in rest]), strict=True):
            out[i] = ids
        return [self._found(ids) for ids in out]

    @staticmethod
    def letters(word: str) -> str:
        """A key's byte letters: those of the library come behind a space, which no word has."""
        if word[0] == " ":
            return word[1:]
        return word if word.isascii() and word.isprintable() else "".join([_LETTERS[b] for b in word.encode()])

    def __missing__(self, word: str) -> tuple[int, str, str]:
        found = self.old.get(word)
        if found is None:
            if word.startswith("  "):
                return 1, str(self.vocabulary.special[word[2:]]), word[2:]
            found = self.words_of([self.letters(word)])[0]
        if len(word) < KEPT:
            self.put({word: found})
        return found

    def put(self, more: dict[str, tuple[int, str, str]]) -> None:
        if len(self) + len(more) > TABLE:
            self.old = dict(self)
            self.clear()
        self.update(more)

    def learn(self, words: Iterable[str]) -> None:
        """Takes the unknown ones of `words`, of which there are fewer than the table holds, in at once."""
        new = [w for w in set(words) if w not in self and len(w) < KEPT and not w.startswith("  ")]
        more = {w: x for w in new if (x := self.old.get(w)) is not None}
        new = [w for w in new if w not in more]
        if new:
            more.update(zip(new, self.words_of([self.letters(w) for w in new]), strict=True))
        self.put(more)

    def split(self, text: str) -> list[str]:
        """The keys of a text's words: plain words, or behind a space the library's, or behind two a special string."""
        if "<|" in text and len(parts := self.vocabulary.split_special.split(text)) > 1:
            special = self.vocabulary.special
            return [k for p in parts if p for k in (["  " + p] if p in special else self.split(p))]
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORDS.findall(text.lower())
        return [" " + letters for letters, _ in self.divide(self.normalise(text))]

    def encode_all(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
        """encode() of each text; words that several of them lack are merged together."""
        lists = [self.split(t) if t else [] for t in texts]
        at = 0
        while at < len(lists):
            to, n = at, 0
            while to < len(lists) and (to == at or n + len(lists[to]) <= TABLE // 2):
                n += len(lists[to])
                to += 1
            if n <= TABLE // 2:
                self.learn(chain.from_iterable(lists[at:to]))
                yield from (list(map(self.__getitem__, words)) for words in lists[at:to])
            else:  # one long text
                found = []
                for i in range(0, n, max(1, TABLE // 2)):
                    words = lists[at][i : i + max(1, TABLE // 2)]
                    self.learn(words)
                    found += map(self.__getitem__, words)
                yield found
            at = to


@lru_cache(2)
def encoder(path: str, name: str) -> Encoder:
    return Encoder(path, np.memmap(SparkFiles.get(name), np.int32, "r"))


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The library's decode of ids: their tokens' strings, with one space between."""
    return " ".join(vocabulary.tokens[i] for i in ids)


def ship(spark: SparkSession, data: np.ndarray) -> str:
    """Puts the arrays in a file of the shared folder, which Spark copies to each executor; gives the file's name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        out.write(bytearray(data.tobytes()))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def encode(docs: DataFrame, path: str, *, frequent: Iterable[str] = (), ids: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256; with `ids` also ids and decoded."""
    name = ship(docs.sparkSession, Vocabulary(path).lexicon(frequent))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())], f"{ddl}, ids array<int>, decoded string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path, name)
        for batch in small_pieces(batches):
            n, first, second, lists, decoded = [], [], [], [], []
            for found in table.encode_all(batch.column(1).to_pylist()):
                counts, each, tokens = zip(*found, strict=True) if found else ((), (), ())
                numbers, joined = " ".join(each), " ".join(tokens)
                n.append(sum(counts))
                first.append(hashlib.sha256(numbers.encode()).hexdigest())
                second.append(hashlib.sha256(joined.encode()).hexdigest())
                if ids:
                    lists.append([int(i) for i in numbers.split()])
                    decoded.append(joined)
            yield pa.record_batch([batch.column(0), n, first, second, *([lists, decoded] if ids else [])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, ddl)
