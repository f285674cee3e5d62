import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

from codeloom.llm.media import SIGNATURES, UNKNOWN, find_media, from_samples, media_digests, sniff, to_samples


def png():
    def chunk(k, d):
        return struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0"


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a.txt", "hello")
    return f.getvalue()


WHOLE = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": to_samples(b"abcde"), "application/gzip": gzip.compress(b"x" * 500), "application/zip": zipped()}


def test_each_format_whole_embedded_and_broken():
    for kind, data in WHOLE.items():
        assert (kind, 0, len(data)) in find_media(data), kind
        assert (kind, 7, len(data)) in find_media(b"GIF89a " + data + b"BM tail"), kind
        assert not [x for x in find_media(data[: len(data) - 3]) if x[0] == kind], kind


def test_sniff_corrects_and_carves(spark):
    rows = [(1, bytearray(png()), "image/gif"), (2, bytearray(b"xx" + GIF + b"yy" + png()), "text/plain"), (3, None, None), (4, bytearray(), "image/png"), (5, bytearray(to_samples(png())), "audio/wav")]
    df = spark.createDataFrame(rows, "id long, blob binary, said string")
    got = {r.id: r for r in sniff(df, "id", "blob", "said").collect()}
    assert (got[1].true_type, got[1].corrected, got[1].media) == ("image/png", True, [])
    assert [(m.type, m.place, bytes(m.data)) for m in got[2].media] == [("image/gif", 2, GIF), ("image/png", 4 + len(GIF), png())]
    assert got[3].true_type == got[4].true_type == UNKNOWN and got[3].corrected
    assert not got[5].corrected and [(m.type, m.place) for m in got[5].media] == [("image/png", 44)]
    assert sniff(df.limit(0), "id", "blob").count() == 0


def test_digests_equal_a_plain_computation(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "RIFF GIF89a BM", "".join(map(chr, (rng.randint(1, 0x7FF) for _ in range(5000)))), "z" * 100_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    for r in media_digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        stored = to_samples(payload)
        assert from_samples(stored) == payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())


def test_feature_against_every_place_and_plain_sums(spark):
    rng = random.Random(5)
    texts = ["", None, "BM", "x" * 64 + "\0" * 7, "é" * 50, "z" * 100_000]
    inside = [BMP.decode(), to_samples(b"abcde").decode(), "GIF89a", "RIFF", "BM", "PK\3\4", "river ", "\0" * 9]
    texts += ["".join(rng.choices(inside, k=rng.randint(1, 12))) for _ in range(60)]
    texts += texts[6:8] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    many = 0
    for r in media_digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        stored = to_samples(payload)
        view = memoryview(stored)
        media = sorted((at, kind) for at in range(1, len(stored)) for magic, kind, check in SIGNATURES if stored.startswith(magic, at) and check(view, at))
        many += len(media)
        inner = ",".join(f"{kind}@{at}" for at, kind in media)
        assert r.feature == f"audio/wav;{len(payload)};{inner};{sum(payload) / len(payload):.6f};{payload.count(0) / len(payload):.6f}"
    assert many > 60
