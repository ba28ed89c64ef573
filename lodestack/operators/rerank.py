"""Rerankers: DataFrame in, DataFrame with a new relevance out."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

Reranker = Callable[[DataFrame, str], DataFrame]


def heuristic(results: DataFrame, query: str, as_of: float | None = None, mtime_col: str | None = None) -> DataFrame:
    """Relevance by type, match, path and recency. ``mtime_col`` holds seconds since 1970 or null (factor 1)."""
    mtime = F.col(mtime_col) if mtime_col else None
    now = F.lit(float(time.time() if as_of is None else as_of))
    return results.withColumn("relevance_score", scoring.heuristic(F.col("score"), F.col("chunk_type"), F.col("content"), F.col("file_path"), query, mtime, now))


def mmr_order(relevance: np.ndarray, vectors: list, lam: float) -> list[int]:
    """Greedy order by lam * relevance - (1 - lam) * highest cosine to the rows taken; the first row wins ties."""
    n = len(relevance)
    units = []
    for v in vectors:
        x = np.asarray(v if v is not None else [], float)
        norm = float(np.sqrt((x * x).sum()))
        units.append(x / norm if norm else None)
    nearest = np.zeros(n)
    left, out = list(range(n)), []
    while left:
        value = [lam * relevance[i] - (1 - lam) * nearest[i] for i in left]
        best = left.pop(int(np.argmax(value)))
        out.append(best)
        for i in left:
            same = units[i] is not None and units[best] is not None and len(units[i]) == len(units[best])
            s = float(units[i] @ units[best]) if same else 0.0
            nearest[i] = s if len(out) == 1 and s > 0 else max(nearest[i], s)
    return out


def mmr(results: DataFrame, lam: float = 0.7, by: str = "query_id") -> DataFrame:
    """Diversity order of each query's results as ``mmr_rank`` (1-based). Groups are top-k lists, so they are bounded."""
    lam = lam if 0 <= lam <= 1 else 0.7
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields], "mmr_rank int"])

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["relevance_score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = mmr_order(d["relevance_score"].to_numpy(float), list(d["embedding"]), lam)
        return d.iloc[order].assign(mmr_rank=np.arange(1, len(d) + 1, dtype=np.int32))

    return results.groupBy(by).applyInPandas(run, schema)


def with_mmr(inner: Reranker, lam: float = 0.7) -> Reranker:
    """A reranker that orders another one's results for diversity."""

    def run(results: DataFrame, query: str) -> DataFrame:
        out = inner(results, query)
        marked = out if "query_id" in out.columns else out.withColumn("query_id", F.lit(0))
        return mmr(marked, lam).drop(*([] if "query_id" in out.columns else ["query_id"]))

    return run
