"""Signature sniffing of binary columns: what media a value really is, and what media lies inside it.

Method. One Aho-Corasick pass over a value's bytes finds every place of every known magic number. At each place the
format's validator follows the structure (chunk lengths and check sums, segments, block lists, header sizes) and either
gives the length of a well-formed object or rejects the place. An object at place 0 that reaches the end (or all but zero
padding) corrects the declared type; every other object is carved out as embedded media.

Plan: one narrow map; a worker holds a few MB at a time and nothing is shuffled.

Defined results. Null or empty value: type `application/octet-stream`, no media. Unknown contents keep that type too,
whatever was declared. Overlapping objects are all reported, in order of place, then of type. Repeated rows stay; other
columns of the input are not in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, small_pieces

UNKNOWN = "application/octet-stream"


def _png(b: memoryview, at: int) -> int:
    p, seen = at + 8, 0
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (seen == 0) != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, seen = p + 12 + n, seen + 1
        if kind == b"IEND":
            return p - at
    return 0


def _riff(b: memoryview, at: int, form: bytes, needed: tuple[bytes, ...]) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0]
    p, end, names = at + 12, at + 8 + size, set()
    if end > len(b):
        return 0
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return 0
        names.add(name)
        p += 8 + n + n % 2
    return end - at if any(x in names for x in needed) and p >= end else 0


def _wav(b: memoryview, at: int) -> int:
    return _riff(b, at, b"WAVE", (b"data",))


def _webp(b: memoryview, at: int) -> int:
    return _riff(b, at, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))


def _gif(b: memoryview, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1 if p < len(b) else 0

    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while 0 < p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at if images else 0
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
            images += 1
        else:
            return 0
    return 0


def _jpeg(b: memoryview, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0x00, 0xD8, 0xD9):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            while p + 1 < len(b):
                if b[p] == 0xFF and b[p + 1] == 0xD9:
                    return p + 2 - at if frame else 0
                if b[p] == 0xFF and b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 1
    return 0


def _bmp(b: memoryview, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, start, head, width, _, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    fits = not zero and head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0
    return size if fits and 14 + head <= start <= size <= len(b) - at else 0


def _gzip(b: memoryview, at: int) -> int:
    d = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - at - len(d.unused_data) if d.eof else 0


def _zip(b: memoryview, at: int) -> int:
    p = at
    while p + 30 <= len(b) and b[p : p + 4] == b"PK\3\4":
        flags, _, _, _, _, packed, _, name, extra = struct.unpack_from("<HHHHIIIHH", b, p + 6)
        if flags & 8:
            return 0
        p += 30 + name + extra + packed
    first, n = p, 0
    while p + 46 <= len(b) and b[p : p + 4] == b"PK\1\2":
        p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
        n += 1
    if not n or p + 22 > len(b) or b[p : p + 4] != b"PK\5\6":
        return 0
    entries, size, start, note = struct.unpack_from("<HIIH", b, p + 10)
    return p + 22 + note - at if (entries, size, start) == (n, p - first, first - at) and p + 22 + note <= len(b) else 0


#: The formats' magic numbers, with the validator of each.
SIGNATURES: list[tuple[bytes, str, Callable[[memoryview, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by: dict[bytes, list] = {}
    for magic, kind, check in SIGNATURES:
        by.setdefault(magic, []).append((kind, check))
    for magic, checks in by.items():
        found.add_word(magic.decode("latin-1"), (len(magic), checks))
    found.make_automaton()
    return found


def find_media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, place, length) of each well-formed object in `data`."""
    view = memoryview(data)
    out = []
    for last, (size, checks) in _automaton().iter(data.decode("latin-1")):
        at = last - size + 1
        out += [(kind, at, n) for kind, check in checks if (n := check(view, at))]
    return sorted(out, key=lambda x: (x[1], x[0]))


def true_type(data: bytes, media: list[tuple[str, int, int]]) -> str:
    """The type of the object that begins `data` and leaves only zero padding; the longest if there are several."""
    for kind, at, n in sorted(media, key=lambda x: (x[1], -x[2])):
        if at == 0 and not data[n:].strip(b"\0"):
            return kind
    return UNKNOWN


def to_samples(data: bytes, rate: int = 8000) -> bytes:
    """`data` as the 8-bit samples of one mono WAV file; nothing is changed or lost."""
    n = len(data)
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + data + b"\0" * (n % 2)


def from_samples(stored: bytes) -> bytes:
    """The samples of a WAV file, found by its chunks."""
    p, end = 12, 8 + struct.unpack_from("<I", stored, 4)[0]
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", stored, p)
        if name == b"data":
            return stored[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def sniff(rows: DataFrame, key: str, column: str, declared: str | None = None) -> DataFrame:
    """Per row: key, declared_type, true_type, corrected (they differ), media array<struct<type, place, length, data>>.

    The object that is the whole value is not listed again in `media`; `data` is the carved bytes.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("data"), (F.col(declared).cast("string") if declared else F.lit(None).cast("string")).alias("declared"))
    piece = pa.struct([("type", pa.string()), ("place", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])
    schema = pa.schema([("declared_type", pa.string()), ("true_type", pa.string()), ("corrected", pa.bool_()), ("media", pa.list_(piece))])
    ddl = f"{key} {rows.schema['key'].dataType.simpleString()}, declared_type string, true_type string, corrected boolean, media array<struct<type string, place long, length long, data binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches, "data"):
            out: list[dict] = []
            for data, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = data or b""
                found = find_media(data)
                kind = true_type(data, found)
                inner = [(k, a, n) for k, a, n in found if not (a == 0 and k == kind)]
                out.append({"declared_type": said, "true_type": kind, "corrected": kind != said, "media": [{"type": k, "place": a, "length": n, "data": data[a : a + n]} for k, a, n in inner]})
            made = pa.RecordBatch.from_pylist(out, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[key, *schema.names])

    return arrow_map(rows, run, ddl)


def media_digests(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Stores each text's bytes, zero-padded to a positive multiple of `unit`, as media, sniffs what was stored and reads it back.

    Per row of `docs` (doc_id, text): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature ("type;samples;embedded types;mean sample;share of zero samples"), all of what was read back.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches):
            out: list[list] = [[] for _ in schema.names[1:]]
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                stored = to_samples(raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw)))
                media = find_media(stored)
                kind = true_type(stored, media)
                if kind != "audio/wav":
                    raise ValueError(f"stored media sniffs as {kind}")
                back = from_samples(stored)
                samples = np.frombuffer(back, np.uint8)
                inner = ",".join(f"{k}@{a}" for k, a, _ in media if a)
                feature = f"{kind};{len(back)};{inner};{samples.mean():.6f};{(samples == 0).mean():.6f}"
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-unit:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.record_batch([batch.column(0), *out], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
