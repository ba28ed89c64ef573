"""Media columns by content-defined payload chunking.

A payload is the UTF-8 text with zero bytes appended to a positive multiple of 64, read as 8-bit samples. A rolling gear hash
cuts it into chunks; a chunk is named by a 128-bit digest of its samples and stored as a zstandard frame. The stored form of a
payload is its recipe (payload length and number of chunks, then digest, length and frame length of each chunk in order)
followed by the chunks' frames in that order. These are the bytes that lie in the tables and are read back; they depend on
the payload alone, so equal texts have equal stored forms.

Tables: ``objects`` (recipe, frames of the chunks that no other object shares, and the documents that are this object; equal
payloads of one slice of a task are one row) and ``chunks`` (each shared chunk once). Which digests are shared is found by a
group-by over digests and summed up in a Bloom filter, sized from their number up to ``MOST_BITS``. It decides where a chunk
is kept, never whether: a false positive only moves an unshared chunk to the chunk table. Shared chunks are deduplicated by
digest before and after their shuffle, and objects that refer to them are put together by a join on the digest and a sort by
object and place. Every distinct object is read back once, each chunk checked against its digest and the whole against its
length, before any figure is computed; a join gives the figures to the object's holders, however many there are.

Null text is an empty payload (64 zero bytes), and so is empty text. Repeated rows, and rows that share an id or have none,
are separate holders with a result row each; very long texts are many chunks. Ties don't occur. An empty table gives an
empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash as bh
from .runtime import Workspace

LEAST, MOST, AVERAGE_BITS = 512, 8192, 11
LEVEL = 3
BITS_A_DIGEST = 16
MOST_BITS = 1 << 28  # 32 MB: for 16 million shared digests; beyond, more unshared chunks are kept as if they were shared
BLOOM_SLICE = 1 << 16
BLOOM_HASHES = 4
PART = "<16sII"  # digest, samples, bytes of the frame
GEAR = bh.mix(np.arange(256, dtype=np.uint64), 0x6EA4).astype(np.uint32)


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of a payload."""
    n = len(data)
    marks = []
    step = 1 << 20
    for base in range(0, n, step):  # the gear hash sees the 32 bytes up to a place
        lead = min(base, 31)
        h = GEAR[data[base - lead : min(n, base + step)]]
        with np.errstate(over="ignore"):
            for shift in (1, 2, 4, 8, 16):
                h[shift:] += h[:-shift] << np.uint32(shift)
        marks.append(np.flatnonzero(h[lead:] >> np.uint32(32 - AVERAGE_BITS) == 0) + base + 1)
    out, last = [], 0
    for at in np.concatenate(marks).tolist() if marks else []:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST:
            last = at
            out.append(last)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunked(text: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, samples) of each chunk of a text's payload."""
    data = payload(text)
    ends = cuts(np.frombuffer(data, np.uint8))
    return [(hashlib.blake2b(data[a:b], digest_size=16).digest(), data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def feature(samples: np.ndarray, n_chunks: int) -> str:
    """Summary of 8-bit samples: count, mean, spread, entropy in bits, crossings of the middle, chunks."""
    c = np.bincount(samples, minlength=256)
    n = len(samples)
    v = np.arange(256)
    mean = float((c * v).sum() / n)
    spread = float(np.sqrt(max(0.0, (c * v * v).sum() / n - mean * mean)))
    p = c[c > 0] / n
    entropy = float(max(0.0, -(p * np.log2(p)).sum()))
    high = samples >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"n={n}|mean={mean:.4f}|spread={spread:.4f}|entropy={entropy:.4f}|crossings={crossings}|chunks={n_chunks}"


def _two(digest: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", digest)


def _bloom_places(d1: np.ndarray, d2: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a, b = d1.view(np.uint64), d2.view(np.uint64) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) >> np.uint64(7) for i in range(BLOOM_HASHES)], axis=1) & np.uint64(bits - 1)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, starts, ends = bh.column(batch, "text")
        found: list[tuple[int, int]] = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            found += [_two(d) for d, _ in chunked(buf[a:b].tobytes())]
        d = np.array(found, np.int64).reshape(-1, 2)
        d, times = np.unique(d, axis=0, return_counts=True) if len(d) else (d, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(times.astype(np.int64))], names=["d1", "d2", "times"])


def _filter_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(_bloom_places(*(batch.column(i).to_numpy() for i in (0, 1)), bits))
            yield pa.RecordBatch.from_arrays([pa.array((places // BLOOM_SLICE).astype(np.int32)), pa.array((places % BLOOM_SLICE).astype(np.int32))], names=["slice", "bit"])

    return run


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    bits = np.zeros(BLOOM_SLICE, bool)
    bits[table.column("bit").to_numpy()] = True
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def filter_bits(n_digests: int) -> int:
    """Size of the filter: a power of two between a slice and ``MOST_BITS``."""
    return min(MOST_BITS, max(BLOOM_SLICE, 1 << (BITS_A_DIGEST * n_digests - 1).bit_length()))


def shared_filter(docs: DataFrame, work: Workspace, n_bits: int | None = None) -> np.ndarray:
    """Bloom filter (``n_bits``, a power of two) of the digests that occur more than once; packed on executors."""
    times = docs.select("text").mapInArrow(_digests, "d1 long, d2 long, times long").groupBy("d1", "d2").agg(F.sum("times").alias("times"))
    shared = work.table(times.filter("times > 1").select("d1", "d2"), "shared")
    n_bits = n_bits or filter_bits(shared.count())
    bits = shared.mapInArrow(_filter_bits(n_bits), "slice int, bit int").distinct()
    out = np.zeros((n_bits // BLOOM_SLICE, BLOOM_SLICE // 8), np.uint8)
    for row in bits.groupBy("slice").applyInArrow(_pack, "slice int, bits binary").collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint8)
    work.drop("shared")
    return out.ravel()


def _store(shared):
    """Object rows and shared chunk rows of a batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, press = shared.value, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            buf, starts, ends = bh.column(batch, "text")
            for i, j in bh.groups(starts, ends, 1 << 22):
                objects: dict[bytes, list] = {}  # text: recipe, common, inline, refers, holders
                frames: dict[bytes, int] = {}  # shared digests of this slice and the sizes of their frames
                chunk_rows = []
                for k in range(i, j):
                    text = buf[starts[k] : ends[k]].tobytes()
                    if text in objects:
                        objects[text][4].append(ids[k].as_py())
                        continue
                    parts = chunked(text)
                    d = np.array([_two(x) for x, _ in parts], np.int64)
                    places = _bloom_places(np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), len(bloom) * 8)
                    common = (bloom[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8) & 1).all(axis=1)
                    recipe, inline = [struct.pack("<QQ", len(text), len(parts))], []
                    for (x, s), c in zip(parts, common.tolist()):
                        if c and x in frames:
                            size = frames[x]
                        else:
                            frame = press.compress(s)
                            size = len(frame)
                            if c:
                                frames[x] = size
                                chunk_rows.append((*_two(x), frame))
                            else:
                                inline.append(frame)
                        recipe.append(struct.pack(PART, x, len(s), size))
                    objects[text] = [b"".join(recipe), np.packbits(common).tobytes(), b"".join(inline), bool(common.any()), [ids[k].as_py()]]
                n, m = len(objects), len(chunk_rows)
                o, c = list(zip(*objects.values())), list(zip(*chunk_rows)) if chunk_rows else [(), (), ()]
                none = [None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["object"] * n + ["chunk"] * m),
                        *[pa.array([*o[q], *none * m], pa.binary()) for q in (0, 1, 2)],
                        pa.array([*o[3], *none * m], pa.bool_()),
                        pa.array([*o[4], *none * m], pa.list_(pa.int64())),
                        *[pa.array([*none * n, *c[q]], pa.int64()) for q in (0, 1)],
                        pa.array([*none * n, *c[2]], pa.binary()),
                    ],
                    names=["kind", "recipe", "common", "inline", "refers", "holders", "d1", "d2", "frame"],
                )

    return run


_STORED = "kind string, recipe binary, common binary, inline binary, refers boolean, holders array<long>, d1 long, d2 long, frame binary"
_FIGURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
FIGURES = [f.split()[0] for f in _FIGURES.split(", ")]


def _parts(recipe: bytes) -> tuple[int, list[tuple[bytes, int, int]]]:
    """Payload length without padding, and (digest, samples, frame bytes) of each chunk."""
    n_bytes, n = struct.unpack_from("<QQ", recipe)
    return n_bytes, [struct.unpack_from(PART, recipe, 16 + struct.calcsize(PART) * k) for k in range(n)]


def _measure(recipe: bytes, common: bytes, inline: bytes, frames: dict[bytes, bytes], unpress) -> tuple:
    """Put an object together, verify it and compute its figures."""
    n_bytes, parts = _parts(recipe)
    flags = np.unpackbits(np.frombuffer(common, np.uint8), count=len(parts))
    at, data, stored = 0, [], [recipe]
    for (digest, length, size), shared in zip(parts, flags.tolist()):
        if shared:
            z = frames[digest]
        else:
            z, at = inline[at : at + size], at + size
        s = unpress.decompress(z)
        if len(z) != size or len(s) != length or hashlib.blake2b(s, digest_size=16).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is damaged")
        data.append(s)
        stored.append(z)
    whole, media = b"".join(data), b"".join(stored)
    if len(whole) != max(64, -(-n_bytes // 64) * 64):
        raise ValueError(f"an object of {n_bytes} bytes came back with {len(whole)}")
    return (n_bytes, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(whole, np.uint8), len(parts)), len(parts))


def _batch(first: pa.Array, name: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*rows)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([first, *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[name, *FIGURES])


def _read_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(holders, figures) of objects that refer to no shared chunk."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        yield _batch(batch.column(0), "holders", [_measure(*(batch.column(k)[i].as_py() for k in (1, 2, 3)), {}, unpress) for i in range(batch.num_rows)])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(object, d1, d2) of the shared chunks of each object, each digest once."""
    for batch in batches:
        key, a, b = [], [], []
        for i in range(batch.num_rows):
            _, parts = _parts(batch.column(1)[i].as_py())
            flags = np.unpackbits(np.frombuffer(batch.column(2)[i].as_py(), np.uint8), count=len(parts))
            for x, y in {_two(d) for (d, _, _), f in zip(parts, flags.tolist()) if f}:
                key.append(batch.column(0)[i].as_py()), a.append(x), b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["object", "d1", "d2"])


def _read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(object, figures) from rows sorted by object: its frames first, then the object."""
    unpress = zstandard.ZstdDecompressor()
    frames: dict[bytes, bytes] = {}
    for batch in batches:
        keys, out = [], []
        cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            if cols["frame"][i].is_valid:
                frames[struct.pack("<qq", cols["d1"][i].as_py(), cols["d2"][i].as_py())] = cols["frame"][i].as_py()
                continue
            keys.append(cols["object"][i].as_py())
            out.append(_measure(*(cols[c][i].as_py() for c in ("recipe", "common", "inline")), frames, unpress))
            frames = {}
        yield _batch(pa.array(keys, pa.binary()), "object", out)


def store_and_measure(spark: SparkSession, docs: DataFrame, n_bits: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): sizes, digests and features of what was read back from the store."""
    work = Workspace(spark, "media")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bloom = spark.sparkContext.broadcast(shared_filter(docs, work, n_bits))
    stored = work.table(docs.mapInArrow(_store(bloom), _STORED), "stored", partition_by=["kind"])
    objects = stored.filter(F.col("kind") == "object")
    chunks = stored.filter(F.col("kind") == "chunk").groupBy("d1", "d2").agg(F.first("frame").alias("frame"))
    chunks = work.table(chunks, "chunks")
    alone = objects.filter(~F.col("refers")).select("holders", "recipe", "common", "inline").mapInArrow(_read_alone, f"holders array<long>, {_FIGURES}")

    joint = objects.filter("refers").withColumn("object", F.unhex(F.md5("recipe")))
    once = joint.groupBy("object").agg(*[F.first(c).alias(c) for c in ("recipe", "common", "inline")])
    once = work.table(once, "once")
    needed = once.select("object", "recipe", "common").mapInArrow(_references, "object binary, d1 long, d2 long")
    frames = needed.join(chunks, ["d1", "d2"]).select("object", F.lit(0).alias("part"), *[F.lit(None).cast("binary").alias(c) for c in ("recipe", "common", "inline")], "d1", "d2", "frame")
    whole = once.select("object", F.lit(1).alias("part"), "recipe", "common", "inline", *[F.lit(None).cast("long").alias(c) for c in ("d1", "d2")], F.lit(None).cast("binary").alias("frame"))
    dealt = frames.unionByName(whole).repartition("object").sortWithinPartitions("object", "part")
    figures = dealt.mapInArrow(_read_joined, f"object binary, {_FIGURES}")
    held = joint.select("object", "holders").join(figures, "object")
    out = alone.unionByName(held.select("holders", *FIGURES))
    return out.select(F.explode("holders").alias("doc_id"), *FIGURES)
