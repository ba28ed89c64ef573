"""Ranking formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of chunk types, boosts and path patterns of the heuristic reranker.
TYPE_WEIGHTS = {"function": 1.2, "class": 1.1, "method": 1.15, "import": 0.8, "comment": 0.5, "other": 1.0}
EXACT_BOOST, TOKEN_BOOST, PATH_BOOST, PRIORITY_BOOST, RECENCY_BOOST = 1.5, 0.3, 1.1, 1.15, 0.3
PRIORITY_PATHS = ["cmd/", "api/", "main", "handler", "server"]
HALF_LIFE_SECONDS = 30 * 24 * 3600.0


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def tf_part(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    norm = F.lit(1 - b) + F.lit(b) * F.try_divide(dl, avgdl)
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * norm)


def rrf(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank) as float; absent ranks count nothing."""
    return F.coalesce((F.lit(1.0) / (F.lit(float(k)) + rank)).cast("float"), F.lit(0.0).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 for different lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm))


def recency(mtime: Column, as_of: Column) -> Column:
    """1 + 0.3 exp(-age / 30 d) with age at least 0; 1 without a time."""
    age = F.greatest(F.lit(0.0), as_of - mtime)
    bonus = F.lit(1.0) + F.lit(RECENCY_BOOST) * F.exp(-age / F.lit(HALF_LIFE_SECONDS))
    return F.when(mtime.isNull(), F.lit(1.0)).otherwise(bonus).cast("float")


def heuristic(score: Column, chunk_type: Column, content: Column, path: Column, query: str, mtime: Column | None = None, as_of: Column | None = None, priority=PRIORITY_PATHS) -> Column:
    """Relevance of a result: score times type, exact match, token coverage, path, priority and recency factors."""
    f32 = lambda x: F.lit(x).cast("float")
    lower = query.lower()
    toks = lower.split()
    long = [t for t in toks if len(t.encode()) >= 3]
    text, where = F.lower(content), F.lower(path)
    weight = None
    for name, w in TYPE_WEIGHTS.items():
        weight = F.when(chunk_type == name, f32(w)) if weight is None else weight.when(chunk_type == name, f32(w))
    out = score.cast("float") * weight.otherwise(f32(1.0))
    out = out * F.when(F.contains(text, F.lit(lower)), f32(EXACT_BOOST)).otherwise(f32(1.0))
    if long:
        matched = sum((F.contains(text, F.lit(t)).cast("int") for t in long[1:]), F.contains(text, F.lit(long[0])).cast("int"))
        ratio = (matched.cast("float") / f32(len(toks))).cast("float")
        out = out * (f32(1.0) + f32(TOKEN_BOOST) * ratio)
        hit = F.contains(where, F.lit(long[0]))
        for t in long[1:]:
            hit = hit | F.contains(where, F.lit(t))
        out = out * F.when(hit, f32(PATH_BOOST)).otherwise(f32(1.0))
    if priority:
        first = F.contains(where, F.lit(priority[0].lower()))
        for p in priority[1:]:
            first = first | F.contains(where, F.lit(p.lower()))
        out = out * F.when(first, f32(PRIORITY_BOOST)).otherwise(f32(1.0))
    if mtime is not None:
        out = out * recency(mtime, as_of)
    return out.cast("float")
