"""Near-duplicate vectors: iterative quantisation to balanced binary codes, multi-index Hamming tables, exact rerank.

Method. On a bounded sample (about `SAMPLE` vectors of least hash) the vectors' principal axes are rotated by iterative
quantisation (alternating signs and an orthogonal Procrustes step) so that signs lose little; thresholds are the sample's
medians, which balances every bit. Each vector gets 64-bit codes. Codes are split in chunks about log2(vectors) bits wide,
so that a table's bucket holds about one unrelated vector at any input size; a vector is entered under its chunk and under
every chunk one bit away, and two vectors meet when their chunks differ in at most two bits. Codes are of centred vectors,
where a pair at the limit lies further apart the more the vectors have in common; so the number of chunks is measured on
pairs at the limit (`limit_pairs`), made from the sample with noise of any direction and with noise like the vectors' own
differences, and those the sample holds. It is the least that meets a share of `RECALL` of each kind; closer pairs are met
nearly always. Pairs met are kept if their first codes lie within the distance in which nearly all of these pairs lie, then
the cosine of the original vectors in double precision decides: no pair below the limit is linked.

Plan. Equal vectors are one node with a count. Table entries are 24 bytes. Buckets larger than `BLOCK` are dealt to pairs
of blocks, so none meets in one task, and pairs within a bucket are compared on codes in numpy and emitted only if near.

Defined results. Null and zero vectors and those with null or non-finite components link with nothing: n_links 0, own
component. Vectors of different lengths never link; each length has its own quantiser. Rows with equal vec_id are separate
vectors. Null vec_id: the row counts as a link of others, its own component is null if it has no other id to take, and it
is kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, cut, hashed_sample, whole_groups
from codeloom.llm.components import components

SAMPLE = 4096
RECALL = 0.97
BLOCK = 256
PAIRS = 2000
#: Chunks beyond which narrower ones are tried.
CHUNKS = 128


def flip(cosine: float) -> float:
    """The share of sign bits in which two vectors at this cosine differ."""
    return math.acos(cosine) / math.pi


def distance(cosine: float, bits: int = 64) -> int:
    p = flip(cosine)
    return math.ceil(bits * p + 3.2 * math.sqrt(bits * p * (1 - p)))


def chunks(n: int, cosine: float) -> tuple[int, int]:
    """(bits of a chunk, least number of chunks) for n vectors without a common direction."""
    width = min(24, max(8, round(math.log2(max(n, 2)))))
    p = flip(cosine)
    met = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(3))
    return width, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def quantiser(sample: np.ndarray, codes: int, *, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(projection d x 64*codes, thresholds): for each rotation, ITQ on the sample's principal axes."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    d = x.shape[1]
    centre = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - centre).T).reshape(d, d))
    axes = axes[:, ::-1][:, : min(d, 64)]
    v = (x - centre) @ axes
    rng = np.random.default_rng(seed)
    parts: list[np.ndarray] = []
    while sum(p.shape[1] for p in parts) < 64 * codes:
        r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
        for _ in range(rounds if len(x) > 1 else 0):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    projection = np.hstack(parts)[:, : 64 * codes]
    return projection, np.median(x @ projection, axis=0)


def encode(x: np.ndarray, projection: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The bits of each vector, as an array of bool."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / norm) @ projection > thresholds


def table_keys(bits: np.ndarray, width: int, count: int) -> np.ndarray:
    """For each vector its chunks and those one bit away, each with the chunk's number above."""
    weight = 1 << np.arange(width, dtype=np.int64)
    per = 64 // width
    flips = np.concatenate([[0], weight])
    out = []
    for k in range(count):
        at = 64 * (k // per) + width * (k % per)
        value = bits[:, at : at + width] @ weight
        out.append((value[:, None] ^ flips) | (k << width))
    return np.concatenate(out, axis=1)


def first_code(bits: np.ndarray) -> np.ndarray:
    """The first 64 bits as one number, bit 0 lowest."""
    return (bits[:, :64].astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def limit_pairs(sample: np.ndarray, cosine: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs at the limit: noise of any direction, noise like differences of vectors, and pairs of the sample."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    x = unit[rng.integers(len(unit), size=PAIRS)]
    kinds = []
    for o in (rng.normal(size=x.shape), unit[rng.integers(len(unit), size=PAIRS)] - unit[rng.integers(len(unit), size=PAIRS)]):
        o -= (o * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(o, axis=1)
        ok = size > 1e-6
        if ok.any():
            kinds.append((x[ok], cosine * x[ok] + math.sqrt(1 - cosine**2) * o[ok] / size[ok, None]))
    found: list[np.ndarray] = []
    for at in range(0, len(unit), 512):
        cos = unit[at : at + 512] @ unit.T
        a, b = np.nonzero((cos >= cosine) & (cos < cosine + (1 - cosine) / 5))
        found.append(np.stack([a + at, b], axis=1))
    held = np.concatenate(found)
    held = held[held[:, 0] < held[:, 1]]
    if len(held) >= 100:
        held = held[rng.permutation(len(held))[:PAIRS]]
        kinds.append((unit[held[:, 0]], unit[held[:, 1]]))
    return kinds


def plan(sample: np.ndarray, n: int, cosine: float) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """(bits of a chunk, number of chunks, projection, thresholds, greatest distance of first codes) for n vectors like the sample."""
    width, least = chunks(n, cosine)
    kinds = limit_pairs(sample, cosine)
    far = distance(cosine)
    while True:
        per, most = 64 // width, max(CHUNKS, least)
        codes = -(-least // per)
        while True:
            projection, thresholds = quantiser(sample, codes)
            have = min(codes * per, most)
            apart = [encode(x, projection, thresholds) != encode(y, projection, thresholds) for x, y in kinds]
            count = least
            for bits in apart:
                met = np.stack([bits[:, 64 * (k // per) + width * (k % per) :][:, :width].sum(axis=1) <= 2 for k in range(have)], axis=1)
                share = np.logical_or.accumulate(met, axis=1).mean(axis=0)
                count = max(count, int(np.argmax(share >= RECALL)) + 1 if share[-1] >= RECALL else have + 1)
            if count <= have or have == most:
                break
            codes = min(2 * codes, -(-most // per))
        if count <= have or width <= 2:
            count = min(count, have)
            break
        width -= 1
    for bits in apart:
        far = max(far, int(np.ceil(np.quantile(bits[:, :64].sum(axis=1), 0.999))))
    codes = -(-count // per)
    return width, count, projection[:, : 64 * codes], thresholds[: 64 * codes], far


def chunk_values(code: np.ndarray, k: int, width: int) -> np.ndarray:
    return code >> np.uint64(width * k)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _candidates(nodes: DataFrame, d: int, n: int, cosine: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes of length d that meet in a bucket and whose first codes are near."""
    sample = sorted(hashed_sample(nodes, "node", SAMPLE, n).select("node", "v").collect())
    width, count, projection, thresholds, far = plan(np.array([r.v for r in sample]), n, cosine)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                bits = encode(_matrix(piece.column(1), d), projection, thresholds)
                code = first_code(bits).view(np.int64)
                key = table_keys(bits, width, count)
                m = key.shape[1]
                yield pa.record_batch([key.ravel(), np.repeat(piece.column(0).to_numpy(), m), np.repeat(code, m)], names=["key", "node", "code"])

    entries = arrow_map(nodes.select("node", "v"), enter, "key long, node long, code long")
    large = cut(entries.groupBy("key").count().where(F.col("count") > BLOCK), like="large")
    dealt = entries.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / F.lit(BLOCK)), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "code")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"]):
            key, i, j, own, node, code = (table.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "code"))
            code = code.view(np.uint64)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            size = np.diff(np.r_[start, len(key)])
            place = np.arange(len(key)) - np.repeat(start, size)
            end = np.repeat(start + size, size)
            for step in range(1, int(size.max())):
                p = np.flatnonzero(np.arange(len(key)) + step < end) if step > 1 else np.flatnonzero(place + 1 < np.repeat(size, size))
                if not len(p):
                    break
                q = p + step
                near = np.bitwise_count(code[p] ^ code[q]) <= far
                near &= (i[p] == j[p]) | (own[p] != own[q])
                p, q = p[near], q[near]
                only = once(key[p], code[p], code[q])
                if only.any():
                    a, b = node[p[only]], node[q[only]]
                    yield pa.record_batch([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

    per = min(count, 64 // width)
    mask = np.uint64((1 << width) - 1)

    def once(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pair is to be emitted under this key: the least key it shares in the first chunk of its first codes
        that is near enough; under keys of later codes only if there is no such chunk."""
        want = np.full(len(key), -1, np.int64)
        for k in range(per):
            u, v = chunk_values(x, k, width) & mask, chunk_values(y, k, width) & mask
            apart = np.bitwise_count(u ^ v)
            one = (u ^ v) & (~(u ^ v) + np.uint64(1))
            least = np.where(apart == 0, u, np.where(apart == 1, np.minimum(u, v), np.minimum(u ^ one, v ^ one)))
            fresh = (want < 0) & (apart <= 2)
            want[fresh] = (least[fresh] | np.uint64(k << width)).astype(np.int64)
        return (want == key) | ((want < 0) & (key >> width >= per))

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return arrow_map(ordered, meet, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, nodes: DataFrame, d: int, cosine: float) -> DataFrame:
    a = nodes.select(F.col("node").alias("a"), F.col("v").alias("x"))
    b = nodes.select(F.col("node").alias("b"), F.col("v").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x, y = _matrix(piece.column(2), d), _matrix(piece.column(3), d)
                cos = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield piece.filter(pa.array(cos >= cosine)).select([0, 1])

    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y"), run, "a long, b long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly, copies included), component_id (least vec_id reachable), kept."""
    v = F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(fine, F.col("v")).alias("v")).withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    known = rows.where("node is not null")
    nodes = cut(known.groupBy("node", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), like="vectors")
    links = []
    for r in nodes.groupBy(F.size("v").alias("d")).count().where("count > 1").collect():  # as many rows as there are lengths
        own = nodes.where(F.size("v") == r.d)
        links.append(_confirmed(_candidates(own, r.d, r["count"], cosine), own, r.d, cosine))
    empty = vectors.sparkSession.createDataFrame([], "a long, b long")
    linked = cut(reduce(DataFrame.unionByName, links, empty), like="links")
    found = components(linked)

    both = linked.union(linked.select("b", "a"))
    others = both.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    least = cut(found.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least")), like="least")
    of = cut(found.join(least, "component").select("node", "least"), like="least")
    each = cut(nodes.select("node", "id", "n").join(cut(others, like="others"), "node", "left").join(of, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("least")), like="nodes")
    out = rows.select("vec_id", "node").join(each, "node", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
