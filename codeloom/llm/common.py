"""What the operators of this package share: tables, cut lineage, text statistics and Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.lineage import shared_dir

#: Bytes of text that a worker takes in at once (one row at least), and of a batch that Spark hands to it.
PIECE = 512 << 10
BATCH_BYTES = 4 << 20
#: Bits of a filter of keys at most: 8 MB, about 25 MB as a table.
FILTER_BITS = 1 << 26
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table. Only Spark's readers touch the path, which may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, *, like: str = "cut") -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: the lineage ends there and survives lost executors.

    Unlike checkpoint() this computes the rows once only, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{like}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(rows: DataFrame, keys: list[str], wanted: DataFrame, named: list[str] | None = None) -> DataFrame:
    """The rows of `rows` whose `keys` may be among those of `wanted` (its columns `named`, if they differ): none of them is
    lost, and few others stay, so that a join to come moves little else. `wanted` should be a table that is cut.

    A Bloom filter of one hash, which Spark joins as a table of 64-bit words. It has 12 to 24 bits for a row of `wanted`, and
    `FILTER_BITS` at most; beyond these more of the other rows stay.
    """
    bits = min(FILTER_BITS, 1 << max(6, (12 * wanted.count() - 1).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(*columns, F.lit("only")), F.lit(bits))
    word = lambda at: F.shiftright(at, 6)
    bit = lambda at: F.pmod(at, F.lit(64)).cast("int")
    at = wanted.select(place(named or keys).alias("at"))
    words = at.groupBy(word(F.col("at")).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("at")))).alias("_bits"))
    own = place([rows[k] for k in keys])
    return rows.join(F.broadcast(words), (word(own) == words["_word"]) & (F.getbit(words["_bits"], bit(own)) == 1), "left_semi")


def free_memory() -> None:
    """Gives back what this process's allocators keep for later; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """df.mapInArrow(run, ddl) with batches of at most `BATCH_BYTES`, whose worker gives memory back at a task's end.

    The limit is a setting of the session, and is only ever lowered.
    """
    bound_batches(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        free_memory()

    return df.mapInArrow(released, ddl)


def bound_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(_BATCH_SETTING).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def row_key(text: Column) -> Column:
    """Tells the texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), text.isNull())


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Bytes of text and number of rows, one map-side aggregate. They size partitions; no result depends on them."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))), F.count(F.lit(1))).first()
    return int(row[0] or 0), int(row[1])


def hashed_sample(rows: DataFrame, key: str | list[str], size: int, total: int) -> DataFrame:
    """About `size` of the `total` rows, those whose key's hash is least; all if there are no more.

    A plain filter: unlike a top-n it sends no more to the driver when there are more tasks.
    """
    share = min(1.0, size / max(total, 1))
    return rows.where(F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows end to end, row offsets). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (one row at least), which bounds a worker's memory."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by `keys`; a group never lies in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held:
            before = held[-1]
            same = all(before.column(before.schema.get_field_index(k))[-1] == batch.column(batch.schema.get_field_index(k))[0] for k in keys)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
