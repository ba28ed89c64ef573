"""Exact cosine top-k. The scan runs in numpy over Arrow batches; each batch sends on its own k best rows only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def cosine_scores(vectors: DataFrame, query: list[float], id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of every vector, as column expressions."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), scoring.cosine(F.col(vec_col), q).alias("score"))


def _matrix(arr: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the right width, matrix); other rows score 0."""
    arr = arr.cast(pa.list_(pa.float64()))
    offsets = np.asarray(arr.offsets)
    fit = (np.diff(offsets) == width) & ~np.asarray(arr.is_null())
    values = np.asarray(arr.values.fill_null(0.0)) if len(arr) else np.zeros(0)
    at = offsets[:-1][fit]
    return fit, values[at[:, None] + np.arange(width)[None, :]] if width else np.zeros((fit.sum(), 0))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k vectors nearest to the query, ids breaking ties."""
    q = np.asarray(query, float)
    norm = float(np.sqrt((q * q).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit, m = _matrix(b.column(1), len(q))
            score = np.zeros(b.num_rows)
            if m.size and norm:
                own = np.sqrt((m * m).sum(axis=1))
                score[fit] = np.where(own > 0, (m @ q) / np.where(own > 0, own * norm, 1.0), 0.0)
            t = pa.table({"id": b.column(0), "score": pa.array(score)})
            yield from t.take(pa.compute.sort_indices(t, [("score", "descending"), ("id", "ascending")])[:k]).to_batches()

    import pyarrow.compute  # noqa: F401  (loads pa.compute)

    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    best = narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double")
    return best.orderBy(F.desc("score"), F.asc("id")).limit(k)
