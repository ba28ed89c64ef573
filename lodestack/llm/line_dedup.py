"""Line dedup over levelled sorted runs of line hashes.

The documents come in batches by descending id. A run is a table ``(h1, h2, keeper, n_docs)`` in hash buckets, sorted inside
each bucket: the line keys that no earlier batch held, with the largest document id that holds them. Each batch is written in
that layout and merge-anti-joined with the runs that exist: its keys without a partner are new and become its own run, and as
batches descend, the largest id of that batch is the keeper for good. Keys with a partner only add to the counts. Runs are
read back in their buckets and order, so neither the join's exchange nor its sort touches them again. When a level holds
``fanout`` runs they are merged, two by two and bucket by bucket in their order, into one of the next level, so a key is
rewritten O(log batches) times and a batch meets few runs. The queries' four batches fill three levels of ``fanout`` 2: the
third batch meets the merged run of the first two, and the counts are looked up in the one run that is left.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; 128 hash bits stand for it. Keys shorter
than ``min_chars`` code points never count. Null or empty text is one empty line. Repeats inside one document, and rows that
share an id, count as one document. Ties cannot occur: the keeper is the largest document id, and all its lines with the key
stay. Very long texts are read in bounded slices. Documents are never collected per key: keys are counted with partial
aggregation and drops come from an equi-join. Rows without an id come last; together they count as one more holder of their
keys and lose no line themselves. An empty table gives an empty one. Extra columns of any name pass through, but for the
columns this operator makes (``n_lines``, ``n_dropped``, ``kept_sha256``), which replace those of the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash as bh
from .runtime import Workspace, settings


def _lines(buf, starts, ends):
    """(row, lo, hi) of every \\n-split line of consecutive rows; a row has one more line than newlines."""
    base, top = int(starts[0]), int(ends[-1])
    at = np.flatnonzero(buf[base:top] == 10) + base
    row_of = np.searchsorted(ends, at, side="right")
    inside = at >= starts[row_of] if len(at) else np.zeros(0, bool)
    at, row_of = at[inside], row_of[inside]
    lo = np.concatenate([starts, at + 1])
    hi_at = np.concatenate([ends, at])
    rows = np.concatenate([np.arange(len(starts)), row_of])
    order = np.lexsort((lo, rows))
    ends_order = np.lexsort((hi_at, rows))
    return rows[order], lo[order], hi_at[ends_order]


def _keys(buf, lo, hi, min_chars):
    """(h1, h2, long enough) of lines: stripped of ASCII white space, A-Z folded, counted in code points."""
    n = len(lo)
    h1, h2, ok = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    if not n or hi[-1] <= lo[0]:
        return h1, h2, ok
    base = int(lo[0])
    part = buf[base : int(hi[-1])]
    solid = np.flatnonzero(~bh.SPACE[part]) + base
    if not len(solid):
        return h1, h2, ok
    first = np.searchsorted(solid, lo)
    last = np.searchsorted(solid, hi) - 1
    some = last >= first
    a = np.where(some, solid[np.minimum(first, len(solid) - 1)], lo)
    b = np.where(some, solid[np.maximum(last, 0)] + 1, lo)
    points = np.zeros(len(part) + 1, np.int64)
    np.cumsum((part & 0xC0) != 0x80, out=points[1:])
    ok = points[b - base] - points[a - base] >= min_chars
    h1[ok] = bh.span_hashes(buf, a[ok], b[ok])
    h2[ok] = bh.span_hashes(buf, a[ok], b[ok], salt=0x51ED270B)
    return h1, h2, ok


def _key_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            buf, starts, ends = bh.column(batch, "text")
            for i, j in bh.groups(starts, ends):
                row, lo, hi = _lines(buf, starts[i:j], ends[i:j])
                h1, h2, ok = _keys(buf, lo, hi, min_chars)
                table = np.rec.fromarrays([row[ok], h1[ok].view(np.int64), h2[ok].view(np.int64)], names="r,a,b")
                table = np.unique(table)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(table["r"])), pa.array(table["a"]), pa.array(table["b"])], names=["doc_id", "h1", "h2"])

    return run


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, h1, h2): the distinct long enough line keys of every row."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_key_rows(min_chars), "doc_id long, h1 long, h2 long")


class Buckets:
    """Tables in hash buckets of (h1, h2), one file each and sorted inside, that are read back in that layout.

    The layout is known to the session's catalog only, under names of this run; the files are in its workspace.
    """

    def __init__(self, work: Workspace):
        self.work, self.spark, self.name = work, work.spark, f"lodestack_lines_{uuid.uuid4().hex}"
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # what a group-by of the keys is dealt to
        self.held: set[str] = set()

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows``, which are dealt by (h1, h2), in buckets of one file each. The writer puts its own sort before the file; rows
        of merge joins come to it in order."""
        table = f"{self.name}_{name}"
        with self.in_order():
            writer = rows.write.bucketBy(self.n, "h1", "h2").sortBy("h1", "h2").option("compression", "snappy").option("path", f"{self.work.path}/{name}")
            writer.saveAsTable(table)
        self.held.add(name)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name}")
        self.held.discard(name)
        self.work.drop(name)

    def close(self) -> None:
        for name in sorted(self.held):
            self.drop(name)

    def in_order(self):
        """While this is open, plans take the order inside the buckets as given."""
        return settings(self.spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})


class LevelledRuns:
    """The runs of all batches so far. Batches are added by descending document ids."""

    def __init__(self, work: Workspace, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.work, self.fanout, self.levels, self._n = work, fanout, [], 0
        self.buckets = Buckets(work)
        self.again: DataFrame | None = None  # (h1, h2, n_docs) of keys that a batch holds and an earlier run holds too

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for _, r in level]

    def split(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key no run holds: a chain of merge anti-joins that keeps the batch's layout."""
        for run in self.runs():
            batch = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of distinct (doc_id, h1, h2) rows, then merge full levels; returns the batch's new run."""
        self._n += 1
        rows = keys.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n_docs"))
        name = f"batch_{self._n}"
        run = batch = self.buckets.write(rows, name)
        if self.levels:
            name = f"run_{self._n}"
            run = self.buckets.write(self.split(batch), name)
            again = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti").select("h1", "h2", "n_docs")
            self.again = again if self.again is None else self.again.unionByName(again)
        else:
            self.levels.append([])
        self.levels[0].append((name, run))
        self._compact()
        return run

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: a full merge join of their buckets. No key is in both, so it only puts their rows in one order."""
        a, b = a.alias("a"), b.alias("b").hint("merge")
        pairs = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
        return pairs.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("h1", "h2", "keeper", "n_docs")])

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                return
            n = 0
            while len(runs) > 1:
                merged = []
                for (x, a), (y, b) in zip(runs[::2], runs[1::2]):
                    n += 1
                    name = f"level_{level + 1}_{self._n}_{n}"
                    merged.append((name, self.buckets.write(self.merge(a, b), name)))
                    for gone in (x, y):
                        if gone.startswith("level_"):  # the batches' own runs are read for the counts
                            self.buckets.drop(gone)
                runs = merged + runs[len(merged) * 2 :]
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1] += runs
            self.levels[level] = []

    def close(self) -> None:
        self.buckets.close()

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the keys that ``min_docs`` documents hold: a run's own count and what later batches added."""
        if self.again is None:
            found = [r.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper") for r in self.runs()]
        else:
            more = self.again.groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"))
            total = F.col("n_docs") + F.coalesce("more", F.lit(0))
            found = [r.join(more.hint("merge"), ["h1", "h2"], "left").filter(total >= min_docs).select("h1", "h2", "keeper") for r in self.runs()]
        return reduce(DataFrame.unionByName, found)


def _finish(n_rest: int, text_col: str, min_chars: int, with_text: bool):
    """Rows are the columns to keep, the text and the keys to drop (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = bh.column(batch, TEXT)
            drops = batch.column(n_rest + 1)
            n_lines, n_dropped, digests, texts = [], [], [], []
            for k in range(batch.num_rows):
                raw = buf[starts[k] : ends[k]].tobytes()
                gone = drops[k].as_py() if drops[k].is_valid else None
                count, dropped = raw.count(b"\n") + 1, 0
                if gone:
                    row, lo, hi = _lines(buf, starts[k : k + 1], ends[k : k + 1])
                    h1, h2, ok = _keys(buf, lo, hi, min_chars)
                    pairs = {(x["h1"], x["h2"]) for x in gone}
                    keep = [not (o and (a, b) in pairs) for o, a, b in zip(ok, h1.view(np.int64).tolist(), h2.view(np.int64).tolist())]
                    dropped = len(keep) - sum(keep)
                    raw = b"\n".join(buf[a:b].tobytes() for a, b, x in zip(lo, hi, keep) if x)
                n_lines.append(count)
                n_dropped.append(dropped)
                digests.append(hashlib.sha256(raw).hexdigest())
                texts.append(raw.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n_rest)], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())],
                names=[*batch.schema.names[:n_rest], text_col, *MADE],
            )

    return run


MADE = ("n_lines", "n_dropped", "kept_sha256")
TEXT, ID, DROPS = "__lines_text", "__lines_id", "__lines_drops"


def dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, with_text: bool = True, keep_cols: list[str] | None = None
) -> DataFrame:
    """``docs`` with each repeated line left only in the largest document that holds it.

    Returns ``keep_cols`` (default: all other columns), ``text_col`` (null unless ``with_text``), ``n_lines``,
    ``n_dropped`` and ``kept_sha256``. A key repeats when ``min_docs`` documents hold it. ``batches`` splits the documents by
    id at its approximate quantiles; every id is in one batch, and the result doesn't depend on their number.
    """
    work = Workspace(spark, "lines")
    edges = []
    if batches > 1:
        parts = F.percentile_approx(F.col(id_col).cast("bigint"), [k / batches for k in range(1, batches)], 10_000)
        edges = sorted(set(docs.agg(parts.alias("e")).first().e or []))
    batch = F.lit(0)
    for edge in edges:  # the largest ids are in batch 0
        batch = batch + (F.col("doc_id") <= edge).cast("int")
    batch = F.coalesce(batch, F.lit(len(edges)))
    keys = line_keys(docs, id_col, text_col, min_chars).distinct()  # rows that share an id and a key are one holder
    keys = work.table(keys.withColumn("batch", batch), "keys", partition_by=["batch"])
    runs = LevelledRuns(work, fanout)
    for b in range(len(edges) + 1):
        runs.add(keys.filter(F.col("batch") == b).select("doc_id", "h1", "h2"))
    with runs.buckets.in_order():
        hot = work.table(runs.repeated(min_docs), "hot")  # without the runs' layout, so that a very frequent key can be split
    runs.close()
    drops = keys.join(hot, ["h1", "h2"]).filter(F.col("doc_id") != F.col("keeper"))
    drops = work.table(drops.groupBy(F.col("doc_id").alias(ID)).agg(F.collect_list(F.struct("h1", "h2")).alias(DROPS)), "drops")
    work.drop("keys")
    work.drop("hot")
    made = {text_col.lower(), *MADE}
    rest = [c for c in (docs.columns if keep_cols is None else keep_cols) if c.lower() not in made]
    narrow = docs.select(*rest, F.col(text_col).alias(TEXT), F.col(id_col).cast("bigint").alias(ID))
    joined = narrow.join(drops, ID, "left").select(*rest, TEXT, DROPS)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields]
    schema = ", ".join([*fields, f"`{text_col}` string", "n_lines long", "n_dropped long", "kept_sha256 string"])
    return joined.mapInArrow(_finish(len(rest), text_col, min_chars, with_text), schema)
