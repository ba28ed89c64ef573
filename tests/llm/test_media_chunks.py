import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestack.llm import media_chunks, queries


def brute(text):
    raw = (text or "").encode()
    data = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])


def rows():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij éß🙂\n") for _ in range(n))
    shared = text(20_000)
    out = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é" * 32, "\0" * 64, "z" * 400_000, text(300_000)]
    out += [text(rng.randint(1, 9000)) for _ in range(40)]
    out += [text(500) + shared + text(700) for _ in range(6)] + [shared] * 3 + ["same text"] * 30
    return [(i, t) for i, t in enumerate(out)] + [(3, "x" * 63)] * 2


@pytest.mark.parametrize("bits", [None, media_chunks.BLOOM_SLICE])
def test_read_back_equals_brute_force(spark, bits):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS recipe", "'k' AS kind").repartition(5)
    got = media_chunks.store_and_measure(spark, df, bits).collect()
    want = sorted((i, *brute(t)) for i, t in data)
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = {}
    texts = dict(data)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], tuple(r)[5:]) == tuple(r)[5:]
        assert r.media_bytes > 0 and len(r.media_sha256) == 64


def test_cuts_depend_on_content():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, 60_000, dtype=np.uint8), rng.integers(0, 256, 777, dtype=np.uint8)
    digest = lambda x: {d for d, _ in media_chunks.chunked(x.tobytes())}
    whole, moved = digest(a), digest(np.concatenate([b, a]))
    assert len(whole & moved) > 0.8 * len(whole)
    sizes = np.diff([0, *media_chunks.cuts(a)])
    assert sizes.max() <= media_chunks.MOST and sizes[:-1].min() >= media_chunks.LEAST and sizes.sum() == len(a)
    assert b"".join(s for _, s in media_chunks.chunked(a.tobytes()))[: len(a)] == a.tobytes()


def test_damage_is_found():
    import zstandard

    with pytest.raises(ValueError):
        media_chunks._measure(*_object(b"hello" * 50, b"hellO" * 50), {}, zstandard.ZstdDecompressor())


def _object(text, other):
    import struct

    import zstandard

    data = media_chunks.payload(text)
    z = zstandard.ZstdCompressor(level=media_chunks.LEVEL, write_content_size=True).compress(media_chunks.payload(other))
    recipe = struct.pack("<QQ", len(text), 1) + struct.pack(media_chunks.PART, hashlib.blake2b(data, digest_size=16).digest(), len(data), len(z))
    return recipe, b"\0", z


def test_media_figures_are_of_the_stored_bytes(spark):
    text = "hello" * 50
    recipe, _, frame = _object(text.encode(), text.encode())
    media = recipe + frame
    for data in ([(1, text)], [(1, text), (2, text), (None, text)] * 40):  # alone, and as a shared chunk
        got = media_chunks.store_and_measure(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
        assert {(r.media_bytes, r.media_sha256) for r in got} == {(len(media), hashlib.sha256(media).hexdigest())}
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in data)


def test_filter_grows_with_the_digests():
    assert [media_chunks.filter_bits(n) for n in (0, 1, 4096, 4097, 10**6, 10**9)] == [1 << 16, 1 << 16, 1 << 16, 1 << 17, 1 << 24, 1 << 28]


def test_empty_and_whole_table(spark, sf):
    assert media_chunks.store_and_measure(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = {r.doc_id: r for r in queries.op8_media_chunks(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert tuple(got[d.doc_id])[1:5] == brute(d.text)
