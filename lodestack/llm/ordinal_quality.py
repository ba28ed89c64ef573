"""Quality classifier: ordinal cumulative-link (proportional odds) regression over hashed text.

Grades are ordered: 0 harmful, 1 poor, 2 good. P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector ``w`` shared by
all thresholds and theta increasing by construction. Features are hashed words and word beginnings (presence, and density in
the text) and bins of a few shape measures. Weights are fitted by AdaGrad in numpy over a bounded, documented sample of
labelled rows: the ``max_docs`` lowest id hashes, as far as their features come to ``max_bytes``; every text is then scored
whole, in bounded slices of rows.

Output: expected grade, tail probability P(grade = best) and ``kept`` (tail at or above the cut). Null or empty text has no
words and only its shape bins; very long texts are one row of features each; rows without labels are scored like any other;
repeated rows get equal scores; of an id's several grades the lowest counts; ties don't occur otherwise. Extra columns are
ignored. An empty table gives an empty one, and without labels all scores come from the initial thresholds.
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

BITS = 18
PREFIXES = (4, 6, 7)


def _word_bytes() -> np.ndarray:
    b = np.arange(256)
    return (b >= 128) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))


WORD = _word_bytes()
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@^~=+_{}[]\\", np.uint8))


def _bins(x: np.ndarray, edges: list[float], tag: int) -> np.ndarray:
    return bh.mix((np.searchsorted(edges, x, side="right") + 100 * tag).astype(np.uint64), 0x5EED)


def featurize(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), sorted by row, of consecutive texts."""
    n = len(starts)
    base, top = (int(starts[0]), int(ends[-1])) if n else (0, 0)
    part = buf[base:top]
    row, lo, hi = bh.words(buf, starts, ends, ~WORD)
    words = np.bincount(row, minlength=n)
    rows, feats = [], []
    for k, cut in enumerate((None, *PREFIXES)):
        end = hi if cut is None else np.minimum(hi, lo + cut)
        rows.append(row)
        feats.append(bh.span_hashes(buf, lo, end, salt=k + 1))
    row, feat = np.concatenate(rows), np.concatenate(feats) >> np.uint64(64 - BITS)
    key = (row.astype(np.uint64) << np.uint64(BITS)) | feat
    key, times = np.unique(key, return_counts=True)
    row, feat = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    dense = np.minimum(1.0, 60.0 * times / np.maximum(words[row], 20))

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[ends - base] - c[starts - base]

    letters, upper, symbols, spaces, newlines = (per_text(m) for m in (WORD[part], UPPER[part], SYMBOL[part], bh.SPACE[part], part == 10))
    distinct = np.bincount(row, minlength=n) / (1 + len(PREFIXES))
    some = np.maximum(words, 1)
    shape = np.stack([
        _bins(words, [1, 5, 10, 20, 40, 100, 300, 1000], 1),
        _bins(upper / np.maximum(letters, 1), [0.02, 0.05, 0.1, 0.2, 0.4, 0.7], 2),
        _bins(symbols / some, [0.001, 0.05, 0.1, 0.3, 0.7, 1.5], 3),
        _bins(letters / some, [2, 3, 4, 5, 6, 8, 12], 4),
        _bins(distinct / some * np.log2(some + 2), [0.5, 1, 2, 3, 4, 5, 6, 7], 5),
        _bins(newlines / some, [0.001, 0.01, 0.05, 0.1, 0.3], 6),
        _bins(spaces / np.maximum(ends - starts, 1), [0.05, 0.1, 0.15, 0.2, 0.3], 7),
    ], axis=1)
    each = np.repeat(np.arange(n), shape.shape[1])
    shape_feat = (shape.ravel() >> np.uint64(64 - BITS)).astype(np.int64)
    size = 1 << BITS
    out_row = np.concatenate([row, row, each])
    out_feat = np.concatenate([feat, feat + size, shape_feat + 2 * size])
    value = np.concatenate([np.full(len(feat), 0.05), dense, np.ones(len(each))])
    order = np.argsort(out_row, kind="stable")
    return out_row[order], out_feat[order].astype(np.int32), value[order].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    theta: np.ndarray

    def at_most(self, s: np.ndarray) -> np.ndarray:
        """P(grade <= k), one column per threshold."""
        return 1 / (1 + np.exp(-np.clip(self.theta[None, :] - s[:, None], -40, 40)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int = 3, epochs: int = 24, rate: float = 0.1, l2: float = 2e-3, min_docs: int = 15, seed: int = 3) -> Model:
    """Fit on (grade, features, values) of each labelled text; features of fewer than ``min_docs`` texts keep weight 0."""
    size = 3 << BITS
    held = np.bincount(np.concatenate([f for _, f, _ in rows]), minlength=size) if rows else np.zeros(size, np.int64)
    known = np.flatnonzero(held >= min_docs)  # the features that are fitted, numbered in order
    number = np.full(size, -1, np.int32)
    number[known] = np.arange(len(known))
    rows = [(y, number[f[on]], v[on].astype(float)) for y, f, v in rows for on in [held[f] >= min_docs] if on.any()]
    w, acc = np.zeros(len(known)), np.full(len(known), 1e-2)
    free, free_acc = np.concatenate([[-2.0], np.full(grades - 2, 0.0)]), np.full(grades - 1, 1e-2)
    rng = np.random.default_rng(seed)

    def theta() -> np.ndarray:
        return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            batch = [rows[i] for i in order[at : at + 32]]
            y = np.array([b[0] for b in batch])
            n = np.array([len(b[1]) for b in batch])
            idx, val = np.concatenate([b[1] for b in batch]), np.concatenate([b[2] for b in batch])
            s = np.add.reduceat(w[idx] * val, np.cumsum(n) - n)
            edges = np.concatenate([[-np.inf], theta(), [np.inf]])
            hi, lo = (1 / (1 + np.exp(-np.clip(edges[y + k] - s, -40, 40))) for k in (1, 0))
            dh, dl = hi * (1 - hi), lo * (1 - lo)
            p = np.maximum(hi - lo, 1e-9)
            ds = (dh - dl) / p / len(y)
            used = np.zeros(len(known), bool)
            used[idx] = True
            step = np.where(used, np.bincount(idx, np.repeat(ds, n) * val, minlength=len(known)) + l2 * w, 0.0)
            acc += step**2
            w -= rate * step / np.sqrt(acc)
            dt = np.zeros(grades + 1)
            np.add.at(dt, y + 1, -dh / p / len(y))
            np.add.at(dt, y, dl / p / len(y))
            dt = dt[1:-1]
            df = np.concatenate([[dt.sum()], np.exp(free[1:]) * np.cumsum(dt[::-1])[::-1][1:]])
            free_acc += df**2
            free -= rate * df / np.sqrt(free_acc)
    weights = np.zeros(size, np.float32)
    weights[known] = w
    return Model(weights, theta())


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, starts, ends = bh.column(batch, "text")
        for i, j in bh.groups(starts, ends):
            row, feat, val = featurize(buf, starts[i:j], ends[i:j])
            cut = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([feat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([val[a:b].astype(np.float16).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["h", "grade", "f", "v"],
            )


def within(sizes: list[tuple], max_bytes: int) -> list[tuple]:
    """Keys of the (key, bytes) rows, in order, that fit ``max_bytes`` together; one that doesn't fit is passed over."""
    out = []
    for key, size in sizes:
        if size <= max_bytes:
            out.append(key)
            max_bytes -= size
    return out


def fit(docs: DataFrame, grades: DataFrame, max_docs: int = 4000, n_grades: int = 3, max_bytes: int = 48 << 20) -> Model:
    """Train on texts joined with (doc_id, grade): at most ``max_docs`` labelled ids, of ``max_bytes`` of features."""
    work = Workspace(docs.sparkSession, "quality")
    chosen = grades.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "grade", "text").mapInArrow(_collect_features, "h long, grade int, f binary, v binary")
    rows = work.table(rows.withColumn("key", F.xxhash64("h", "f", "v")), "sample")
    sizes = rows.groupBy("h", "key").agg(F.max(F.length("f") + F.length("v")).alias("size")).collect()  # numbers only, of the sample
    fits = within([((r.h, r.key), r["size"]) for r in sorted(sizes)], max_bytes)
    table = docs.sparkSession.createDataFrame(fits, "h long, key long")
    got = rows.join(F.broadcast(table), ["h", "key"]).dropDuplicates(["h", "key"]).collect()
    work.drop()
    got.sort(key=lambda r: (r.h, r.key))
    return train([(r.grade, np.frombuffer(r.f, np.int32), np.frombuffer(r.v, np.float16).astype(np.float32)) for r in got], n_grades)


def _score(model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            buf, starts, ends = bh.column(batch, "text")
            for i, j in bh.groups(starts, ends):
                row, feat, val = featurize(buf, starts[i:j], ends[i:j])
                s = np.bincount(row, m.weights[feat] * val, minlength=j - i)
                low = m.at_most(s)
                tail = 1 - low[:, -1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array((1 - low).sum(axis=1)), pa.array(tail), pa.array(tail >= cut)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return run


def score(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(shared, cut), "doc_id long, expected_grade double, tail_probability double, kept boolean")
