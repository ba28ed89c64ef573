"""Files to chunks: Go declarations, pattern blocks, or windows of lines, by language.

Input rows are (path, content) with content as bytes or text; output rows follow ``schema.PARSED``. A file whose Go source
doesn't parse gives no chunks (``parse_errors`` lists it). Blocks and windows are array expressions inside the row, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import text
from ..schema import PARSED
from . import golang

WINDOW, STRIDE = 50, 45


def _source(files: DataFrame) -> DataFrame:
    return files.select("path", text.valid_utf8(F.col("content")).alias("content"), lang.language(F.col("path")).alias("language"))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def _windows(lines: Column) -> Column:
    """Windows of 50 lines every 45; the last one ends the file; blank windows are left out."""
    n = F.size(lines)
    count = F.greatest(F.lit(0), F.ceil((n - WINDOW) / F.lit(float(STRIDE))).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), count), lambda k: k * STRIDE)
    piece = lambda s: F.struct(F.array_join(F.slice(lines, s + 1, F.lit(WINDOW)), "\n").alias("content"), (s + 1).alias("start_line"), F.least(s + WINDOW, n).alias("end_line"), F.lit("other").alias("chunk_type"), F.lit(None).cast("string").alias("name"))
    return F.filter(F.transform(starts, piece), lambda x: ~_blank(x["content"]))


def _blocks(lines: Column, language: Column) -> Column:
    """Blocks from each declaration line to the next; trailing blank lines go; text before the first is left out."""
    n = F.size(lines)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(lang.starts_declaration(language, x), i)), lambda i: i.isNotNull())

    def cut(at: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), n)
            raw = F.array_join(F.slice(lines, s + 1, end - s), "\n")
            text = F.regexp_replace(raw, r"(?U)(\n\s*)+\z", "")
            size = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
            first = F.get(lines, s)
            return F.struct(text.alias("content"), (s + 1).alias("start_line"), (s + size).alias("end_line"), lang.declaration_type(first).alias("chunk_type"), lang.declaration_name(first).alias("name"))

        return F.filter(F.transform(at, block), lambda x: ~_blank(x["content"]))

    return F.element_at(F.transform(F.array(marks), cut), 1)


def _rows(files: DataFrame, pieces) -> DataFrame:
    """``pieces(lines, language)`` exploded into PARSED rows."""
    src = files.withColumn("lines", F.split("content", "\n"))
    both = F.element_at(F.transform(F.array(F.col("lines")), lambda x: pieces(x, F.col("language"))), 1)
    rows = src.select(F.col("path").alias("file_path"), "language", F.posexplode(both).alias("seq", "p"))
    none = F.create_map().cast("map<string,string>")
    meta = F.when(F.col("p.name").isNotNull(), F.create_map(F.lit("name"), F.col("p.name"))).otherwise(none)
    return rows.select("file_path", "language", "p.content", "p.chunk_type", "p.start_line", "p.end_line", meta.alias("metadata"), "seq")


def line_windows(files: DataFrame) -> DataFrame:
    """(path, content text, language) as overlapping windows of lines."""
    return _rows(files, lambda lines, _: _windows(lines))


def pattern_blocks(files: DataFrame) -> DataFrame:
    """Blocks by declaration patterns; files without any match fall back to windows."""

    def pieces(lines: Column, language: Column) -> Column:
        return F.element_at(F.transform(F.array(_blocks(lines, language)), lambda b: F.when(F.size(b) > 0, b).otherwise(_windows(lines))), 1)

    return _rows(files, pieces)


def _go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int32()]
    names = [f.split(" ")[0] for f in PARSED.split(", ")[:6]] + ["metadata", "seq"]
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                found = golang.declarations(content or "")
            except golang.GoSyntaxError:
                continue
            rows += [(path, "go", d["content"], d["chunk_type"], d["start_line"], d["end_line"], list(d["metadata"].items()), k) for k, d in enumerate(found)]
        cols = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _go_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                golang.declarations(content or "")
            except golang.GoSyntaxError as e:
                rows.append((path, str(e)))
        cols = list(zip(*rows)) if rows else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "error"])


def go_declarations(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_go, PARSED)


def parse(files: DataFrame) -> DataFrame:
    """Chunks of all files, each by its language's parser; unknown languages give none."""
    src = _source(files)
    windowed = src.filter(F.col("language").isin(list(lang.LINE_WINDOW_LANGUAGES)))
    coded = src.filter(lang.has_patterns(F.col("language")))
    out = go_declarations(src.filter("language = 'go'")).unionByName(pattern_blocks(coded)).unionByName(line_windows(windowed))
    return out.filter(F.trim("content") != "")


def parse_errors(files: DataFrame) -> DataFrame:
    """(path, error) of files that no parser accepts."""
    return _source(files).filter("language = 'go'").select("path", "content").mapInArrow(_go_errors, "path string, error string")
