"""Token counts under a piece vocabulary (byte-pair merges by score, byte fallback) with a whole-token shortcut.

Method. Two characters that no piece holds side by side can never be merged, so a text falls apart at every such place
into pre-tokens that are encoded independently; here the places before a space mark and around a line feed are used, if
the vocabulary proves them (otherwise only the proven ones). Offline, each vocabulary string is merged by itself: those
that end as one token are the whole-token set, and a pre-token in that set counts 1. Only the rest is merged, with the
exact rule: always the adjacent pair whose union is the piece of highest score, leftmost first; characters that are no
piece cost one token for each UTF-8 byte. Results of merges are memoised in a bounded table per worker.

Plan: one narrow map over the documents; nothing is shuffled, and a worker holds a few MB of text.

Defined results. Null text counts as empty: 0 tokens, 0 bytes. No begin or end marks; their strings inside a text are
ordinary text. Whole texts, never cut; repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, small_pieces

MARK = "▁"
#: Entries of a worker's table of merged pre-tokens; it starts anew when full.
TABLE = 400_000
_NORMAL, _USER = 1, 4


class Pieces(dict):
    """pre-token -> number of tokens; fills itself by merging."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("this operator takes byte-pair models with byte fallback and without normalisation")
        if any(p.type == _USER for p in proto.pieces):
            raise ValueError("this operator takes no user-defined pieces")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        several = [p for p in self.score if len(p) > 1]
        inner = {b for p in several for b in zip(p, p[1:], strict=False)}
        if any(b == MARK and a != MARK for a, b in inner) or any("\n" in p for p in several):
            raise ValueError("pieces cross a space mark or a line feed")
        self.line_feed = 1
        self.whole = frozenset(p for p in self.score if self.merge(p) == 1)

    def merge(self, s: str) -> int:
        """The number of tokens of a pre-token, by the exact merges; O(n log n)."""
        n, score = len(s), self.score
        part: list[str] = list(s)
        if n > 1:
            left, right = list(range(-1, n - 1)), [*range(1, n), -1]
            queue: list[tuple[float, int, str]] = []
            for i in range(n - 1):
                if (x := score.get(both := part[i] + part[i + 1])) is not None:
                    queue.append((-x, i, both))
            heapq.heapify(queue)
            while queue:
                _, i, both = heapq.heappop(queue)
                j = right[i] if part[i] else -1
                if j < 0 or part[i] + part[j] != both:
                    continue
                part[i], part[j] = both, ""
                k = right[i] = right[j]
                if k >= 0:
                    left[k] = i
                    if (x := score.get(more := both + part[k])) is not None:
                        heapq.heappush(queue, (-x, i, more))
                if (k := left[i]) >= 0 and (x := score.get(more := part[k] + both)) is not None:
                    heapq.heappush(queue, (-x, k, more))
        return sum(1 if p in score else len(p.encode()) for p in part if p)

    def __missing__(self, s: str) -> int:
        n = 1 if s in self.whole else self.merge(s)
        if len(s) < 64:
            if len(self) >= TABLE:
                self.clear()
            self[s] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        s = self.prefix + text.replace(" ", MARK)
        feeds = s.count("\n")
        if MARK + MARK in s:
            parts = _RUNS.findall(s)
        else:
            parts = s.replace("\n", " ").replace(MARK, " " + MARK).split(" ")
        return feeds * self.line_feed + sum([self[p] for p in parts if p])


_RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+")


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model_path)
        for batch in small_pieces(batches):
            texts = batch.column(1).to_pylist()
            n = [table.count(t) if t else 0 for t in texts]
            yield pa.record_batch([batch.column(0), [len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
