"""Parsed chunks to stored chunks: merge comments with the code they lead, fill metadata, split what is too large, name by hash.

Sizes and offsets are bytes. Windows of a split start every ``max_size - overlap`` bytes whatever their break points, so bytes
after an early break are not in any piece; ``lossless=True`` starts the next window at the break instead.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

CONTEXT = b"// ...context...\n"
CODE = ("function", "class", "method")
PIECES = "array<struct<id:string,content:string,start_line:int,end_line:int>>"


def step_of(max_size: int, overlap: int) -> int:
    step = max_size - overlap
    return step if step >= 1 else max(max_size // 2, 1)


def block_end(window: bytes) -> int:
    """Place after the last closing bracket that returns to depth 0, strictly inside the window; -1 if there is none."""
    depth, last = 0, -1
    for m in re.finditer(rb"[{(\[\])}]", window):
        if m[0] in b"{([":
            depth += 1
        else:
            depth -= 1
            if depth <= 0:
                depth, last = 0, m.end()
    return last if 0 < last < len(window) else -1


def break_point(data: bytes, start: int, end: int, max_size: int) -> int:
    """Where a window ends: block end, blank line, newline in its last fifth, or its hard end."""
    if end >= len(data):
        return end
    window = data[start:end]
    at = block_end(window)
    if at > 0:
        return start + at
    at = window.rfind(b"\n\n")
    if at > 0:
        return start + at + 2
    at = window.rfind(b"\n")
    fifth = max_size // 5
    if fifth > 0 and at > max_size - fifth:
        return start + at + 1
    return end


def split_spans(data: bytes, max_size: int, overlap: int, lossless: bool = False) -> list[tuple[int, int]]:
    """Byte ranges of the pieces of a large chunk."""
    step, start, out = step_of(max_size, overlap), 0, []
    while start < len(data):
        stop = break_point(data, start, min(start + max_size, len(data)), max_size)
        out.append((start, stop))
        if stop >= len(data):
            break
        start = max(start + 1, min(start + step, stop - overlap)) if lossless else start + step
    return out


def _text(raw: bytes) -> str:
    return re.sub("�+", "�", raw.decode("utf-8", "replace"))


def split_pieces(path: str, content: str, start_line: int, max_size: int, overlap: int, lossless: bool = False) -> list[tuple]:
    """(id, content, start_line, end_line) of the pieces, each after the first led by the end of the one before."""
    data, lead, out = content.encode(), b"", []
    for a, b in split_spans(data, max_size, overlap, lossless):
        piece = lead + data[a:b]
        first = start_line + data[:a].count(b"\n")
        last = first + piece.count(b"\n")
        name = hashlib.sha256(b"%s:%d:%d:" % (path.encode(), first, last) + piece).hexdigest()[:32]
        out.append((name, _text(piece), first, last))
        if overlap > 0 and b > a:
            at = max(0, b - a - overlap)
            while at > 0 and data[a + at] & 0xC0 == 0x80:
                at -= 1
            lead = CONTEXT + data[a + at : b]
    return out


def merge_comments(parsed: DataFrame) -> DataFrame:
    """A comment chunk and the function, class or method after it (by seq in the file) become one chunk."""
    w = Window.partitionBy("file_path").orderBy("seq")
    is_comment, is_code = F.col("chunk_type") == "comment", F.col("chunk_type").isin(list(CODE))
    pair = F.struct("content", "chunk_type", "end_line", "metadata", "language")
    df = parsed.withColumn("_next", F.lead(F.when(is_code, pair)).over(w)).withColumn("_led", F.coalesce(F.lag(is_comment).over(w), F.lit(False)) & is_code)
    df = df.filter(~F.col("_led"))
    joined = is_comment & F.col("_next").isNotNull()
    either = F.transform_keys(F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("_next.metadata"), k)), lambda k, v: k)
    merged = F.map_concat(either, F.map_filter("_next.metadata", lambda k, v: k != "merged_from_comment"), F.create_map(F.lit("merged_from_comment"), F.lit("true")))
    return df.select(
        "file_path",
        F.when(joined, F.col("_next.language")).otherwise(F.col("language")).alias("language"),
        F.when(joined, F.concat("content", F.lit("\n"), "_next.content")).otherwise(F.col("content")).alias("content"),
        F.when(joined, F.col("_next.chunk_type")).otherwise(F.col("chunk_type")).alias("chunk_type"),
        "start_line",
        F.when(joined, F.col("_next.end_line")).otherwise(F.col("end_line")).alias("end_line"),
        F.when(joined, merged).otherwise(F.col("metadata")).alias("metadata"),
        "seq",
    )


def fill_metadata(df: DataFrame) -> DataFrame:
    """Type, language and path unless set; symbol_name follows a non-empty name."""
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    given = F.create_map(F.lit("chunk_type"), F.col("chunk_type"), F.lit("language"), F.col("language"), F.lit("file_path"), F.col("file_path"))
    missing = F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(m), k))
    name = F.element_at(m, F.lit("name"))
    own = F.map_filter(m, lambda k, v: (k != "symbol_name") | F.coalesce(name == "", F.lit(True)))
    symbol = F.when(F.coalesce(name != "", F.lit(False)), F.create_map(F.lit("symbol_name"), name)).otherwise(F.create_map().cast("map<string,string>"))
    return df.withColumn("metadata", F.map_concat(missing, own, symbol))


def chunk(parsed: DataFrame, max_size: int = 512, overlap: int = 50, lossless: bool = False, merge: bool = True) -> DataFrame:
    """Stored chunks (without vectors). Only chunks over ``max_size`` bytes reach the Python splitter."""

    @F.pandas_udf(PIECES)
    def split(path: pd.Series, content: pd.Series, line: pd.Series) -> pd.Series:
        fields = ("id", "content", "start_line", "end_line")
        return pd.Series([[dict(zip(fields, p)) for p in split_pieces(f, c, int(n), max_size, overlap, lossless)] for f, c, n in zip(path, content, line)])

    df = fill_metadata(merge_comments(parsed) if merge else parsed)
    large = F.octet_length("content") > max_size
    whole = df.filter(~large).withColumn("id", text.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")))
    cut = df.filter(large).withColumn("p", F.explode(split("file_path", "content", "start_line")))
    lines = F.create_map(F.lit("start_line"), F.col("p.start_line").cast("string"), F.lit("end_line"), F.col("p.end_line").cast("string"))
    kept = F.map_filter("metadata", lambda k, v: ~k.isin(["start_line", "end_line"]))
    cut = cut.select("file_path", "language", F.col("p.content").alias("content"), "chunk_type", F.col("p.start_line").alias("start_line"), F.col("p.end_line").alias("end_line"), F.map_concat(kept, lines).alias("metadata"), "seq", F.col("p.id").alias("id"))
    out = whole.unionByName(cut)
    return out.select("id", "file_path", "language", "content", "chunk_type", "start_line", "end_line", "metadata", F.array().cast("array<string>").alias("dependencies"))
