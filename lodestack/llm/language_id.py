"""Language identification by averaged hashed subword embeddings with a linear softmax, trained in numpy.

A text's features are its byte n-grams of one to three bytes (A-Z lower-cased; digits and ASCII punctuation read as
blanks), hashed to buckets. The text's vector is the mean of the buckets' embeddings, and a softmax layer scores the
languages. Training is stochastic gradient descent over whole texts, each in up to ``PARTS`` consecutive parts, of a bounded,
documented sample of labelled rows: ``max_docs`` rows, dealt evenly to the languages (what a rare language leaves goes to the
others, and each has one at least, so the total is ``max_docs`` or the number of languages); of a language, those with the
lowest id hashes, as far as their texts come to ``max_bytes`` in all (dealt evenly too; a text counts whole or not at all). A
temperature is fitted on a validation part, and the rejection threshold accepts ``accept`` of its correct predictions.

Prediction reads whole texts, however long, in bounded pieces. Embedding and softmax weights fold into one bucket-by-language
table, which is all that is broadcast (its size is bounded by the buckets and the number of languages). Null text, or text
without a letter, is ``und`` with score 0 and rejected. Ties go to the first language by name; repeated rows get equal
results, and an empty table an empty one. Without any labelled row every text is ``und``. Extra columns pass through, but for
those this operator makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as bh
from .runtime import Workspace

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PARTS, PART_BYTES = 4, 64  # parts of a text to train on, of this many bytes at least
UNKNOWN = "und"
SLOT_BITS = 10


def _fold() -> np.ndarray:
    b = np.arange(256)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    plain = (b < 128) & ~((b >= 97) & (b <= 122))
    return np.where(plain, 32, b).astype(np.uint32)


FOLD = _fold()


def _grams(folded: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last n - 1 have none)."""
    h = np.full(len(folded) - n + 1, n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ folded[i : len(folded) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32)


def features(text: bytes) -> np.ndarray:
    """All feature buckets of one text."""
    f = FOLD[np.frombuffer(text, np.uint8)]
    return np.concatenate([_grams(f, n) for n in ORDERS if len(f) >= n]) if len(f) else np.zeros(0, np.int32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes]], dim: int = 8, epochs: int = 6, rate: float = 0.5, accept: float = 0.995, seed: int = 7) -> Model:
    """Fit on (language, segment) pairs; every tenth pair is kept for calibration."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    rows = []
    for lang, raw in samples:
        ids, times = np.unique(features(raw), return_counts=True)
        if len(ids):
            rows.append((languages.index(lang), ids, times / times.sum()))
    rng.shuffle(rows)
    cut = len(rows) // 10
    held, fit = rows[:cut], rows[cut:] or rows
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    out, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    share = np.bincount([y for y, _, _ in fit], minlength=len(languages)).astype(float)
    weight = np.sqrt(len(fit) / np.maximum(share, 1) / len(languages))
    for epoch in range(epochs):
        order = rng.permutation(len(fit))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(order), 64):
            batch = [fit[i] for i in order[at : at + 64]]
            y = np.array([b[0] for b in batch])
            n = np.array([len(b[1]) for b in batch])
            ids, part = np.concatenate([b[1] for b in batch]), np.concatenate([b[2] for b in batch])
            own = np.repeat(np.arange(len(batch)), n)
            mean = np.add.reduceat(emb[ids] * part[:, None], np.cumsum(n) - n, axis=0)
            p = _softmax(mean @ out + bias)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(y)
            back = (p @ out.T) * len(languages) * 8
            out -= lr * (mean.T @ p) * 8
            bias -= lr * p.sum(axis=0)
            for d in range(dim):
                emb[:, d] -= lr * 8 * np.bincount(ids, back[own, d] * part, minlength=BUCKETS)
    table = (emb @ out).astype(np.float32)
    z = np.array([w @ table[f] + bias for _, f, w in held or fit])
    y = np.array([b[0] for b in held or fit])
    grid = np.exp(np.linspace(-4, 2, 61))
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z / t)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return Model(languages, table, bias, t, float(np.quantile(right, 1 - accept)) if len(right) else 0.0)


def _has_letter(raw: bytes) -> bool:
    if raw.isascii():
        return any(65 <= b <= 90 or 97 <= b <= 122 for b in set(raw))
    return any(c.isalpha() for c in set(raw.decode("utf-8", "ignore")))


def scores(model: Model, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean table row of each text's features, whole texts in bounded pieces of bytes."""
    total = np.zeros((len(starts), len(model.languages)))
    count = np.zeros(len(starts))
    step = 1 << 18
    for base in range(int(starts[0]) if len(starts) else 0, int(ends[-1]) if len(starts) else 0, step):
        top = min(base + step, int(ends[-1]))
        reach = min(top + max(ORDERS) - 1, int(ends[-1]))
        f = FOLD[buf[base:reach]]
        first, last = np.searchsorted(ends, base, side="right"), np.searchsorted(starts, top)
        for n in ORDERS:
            if len(f) < n:
                continue
            h = _grams(f, n)[: top - base]
            sums = np.zeros((len(h) + 1, total.shape[1]))
            np.cumsum(model.table[h], axis=0, out=sums[1:], dtype=np.float64)
            a = np.clip(starts[first:last] - base, 0, len(h))
            b = np.clip(ends[first:last] - (n - 1) - base, a, np.maximum(a, len(h)))
            total[first:last] += sums[b] - sums[a]
            count[first:last] += b - a
    return total / np.maximum(count, 1)[:, None] + model.bias


def _predict(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            buf, starts, ends = bh.column(batch, text_col)
            rest = [i for i, n in enumerate(batch.schema.names) if n != text_col]
            names = [batch.schema.names[i] for i in rest] + ["lang_pred", "score", "accepted"]
            known = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                known[k] = bool(m.languages) and _has_letter(buf[starts[k] : ends[k]].tobytes())
            if m.languages and batch.num_rows:
                p = _softmax(np.concatenate([scores(m, buf, starts[i:j], ends[i:j]) for i, j in bh.groups(starts, ends)]) / m.temperature)
                best, top = p.argmax(axis=1), p.max(axis=1)
            else:
                best, top = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            pred = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            top = np.where(known, top, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(pred, pa.string()), pa.array(top), pa.array(known & (top >= m.threshold))], names=names)

    return run


def parts(text: bytes) -> list[bytes]:
    """The whole of a text in consecutive parts of like size, cut between characters."""
    n = max(1, min(PARTS, len(text) // PART_BYTES))
    cuts = [0]
    for k in range(1, n):
        at = len(text) * k // n
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if b > a]


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows that each language gets of ``total``: even parts, where what a small one leaves goes to the others; one at least."""
    out, left = {}, total
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = max(1, min(counts[lang], left // (len(counts) - k)))
        left -= out[lang]
    return out


def sample(rows: DataFrame, max_docs: int) -> DataFrame:
    """(doc_id, lang) of the rows to train on: of each language its share, by the lowest id hashes."""
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    slot = F.shiftright("h", 64 - SLOT_BITS)
    slots: dict[str, list[tuple[int, int]]] = {}
    for r in hashed.groupBy("lang", slot.alias("slot")).count().collect():  # numbers only, at most 2 ** SLOT_BITS a language
        slots.setdefault(r.lang, []).append((r.slot, r["count"]))
    share = shares({lang: sum(n for _, n in x) for lang, x in slots.items()}, max_docs)
    last = []
    for lang, x in slots.items():
        x, need = sorted(x), share[lang]
        while need > 0:
            at, n = x.pop(0)
            need -= n
        last.append((lang, at))
    spark = rows.sparkSession
    near = hashed.join(F.broadcast(spark.createDataFrame(last, "lang string, last long")), "lang").filter(slot <= F.col("last"))
    best: dict[str, list] = {}
    for r in near.collect():  # ids only, the shares and at most one slot more of each language
        best.setdefault(r.lang, []).append((r.h, r.doc_id))
    chosen = {(i, lang) for lang, x in best.items() for _, i in sorted(x)[: share[lang]]}
    return spark.createDataFrame(sorted(chosen), rows.select("doc_id", "lang").schema)


def within(sizes: list[tuple[str, int, int]], max_bytes: int) -> set[tuple[str, int]]:
    """(lang, key) of the (lang, key, bytes) rows, in order, that fit an even part of ``max_bytes`` for each language.

    A text that doesn't fit is passed over; where none fits, the shortest is taken."""
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for lang, key, size in sizes:
        by_lang.setdefault(lang, []).append((key, size))
    out = set()
    for lang, rows in by_lang.items():
        room, mine = max_bytes // len(by_lang), []
        for key, size in rows:
            if size <= room:
                mine.append(key)
                room -= size
        out |= {(lang, key) for key in mine or [min(rows, key=lambda r: r[1])[0]]}
    return out


def fit(docs: DataFrame, max_docs: int = 4000, max_bytes: int = 32 << 20) -> Model:
    """Train on a bounded sample of rows with text and lang: ``max_docs`` of them, of ``max_bytes`` in all."""
    work = Workspace(docs.sparkSession, "lang")
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = rows.join(F.broadcast(sample(rows, max_docs)), ["doc_id", "lang"])  # ids only; texts never go through a sort
    key = F.xxhash64("doc_id", "text").alias("key")
    chosen = work.table(chosen.select("lang", "text", key, F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("size")), "sample")
    sizes = chosen.groupBy("lang", "h", "key").agg(F.max("size").alias("size")).collect()  # numbers only, of the sample
    fits = sorted(within([(r.lang, r.key, r["size"]) for r in sorted(sizes, key=lambda r: (r.lang, r.h, r.key))], max_bytes))
    table = docs.sparkSession.createDataFrame(fits, "lang string, key long")
    got = chosen.join(F.broadcast(table), ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "text").collect()
    samples = sorted((r.lang, part) for r in got for part in parts(r.text.encode()) if _has_letter(part))
    work.drop()
    return train(samples)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with lang_pred, score and accepted (columns of those names are replaced)."""
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "accepted")])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared, text_col), ", ".join([*fields, "lang_pred string", "score double", "accepted boolean"]))
