"""File changes as streams: a directory-diff source, debouncing, unchanged-content filtering, and applying to an engine."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import EVENTS
from ..sources.files import list_files

GAP = "500 milliseconds"
KINDS = ("create", "modify", "delete")


def classify(op):
    """create, then write (modify), then remove (delete) in a raw operation list such as ``CREATE|WRITE``; others are null."""
    o = F.upper(op)
    return F.when(o.contains("CREATE"), "create").when(o.contains("WRITE"), "modify").when(o.contains("REMOVE"), "delete")


def debounce(events: DataFrame, gap: str = GAP, watermark: str | None = None, order_col: str | None = None) -> DataFrame:
    """One row per burst of a path's events: the last event of each session with gaps up to ``gap``.

    The same plan serves tables and streams; a stream needs a watermark, after which closed sessions are emitted.
    """
    src = events.filter(F.col("event").isin(list(KINDS)))
    if watermark:
        src = src.withWatermark("ts", watermark)
    last = F.struct("ts", order_col) if order_col else F.col("ts")
    out = src.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("event", last).alias("event"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_events"))
    return out.select("path", "event", "ts", "n_events", F.col("w.start").alias("first_ts"))


def actions(events: DataFrame) -> DataFrame:
    """delete events delete; all others index."""
    return events.withColumn("action", F.when(F.col("event") == "delete", "delete").otherwise("index"))


def skip_unchanged(contents: DataFrame) -> DataFrame:
    """Stream of (path, md5, event) without rows whose md5 the path already had; deletes forget the path."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        out = []
        for d in parts:
            for r in d.sort_values("seq").itertuples():
                if r.event == "delete":
                    known = None
                elif r.md5 == known:
                    continue
                else:
                    known = r.md5
                out.append((key[0], r.md5, r.event, r.seq))
        if known is None:
            if state.exists:
                state.remove()
        else:
            state.update((known,))
        yield pd.DataFrame(out, columns=["path", "md5", "event", "seq"])

    return contents.groupBy("path").applyInPandasWithState(run, "path string, md5 string, event string, seq long", "md5 string", "append", GroupStateTimeout.NoTimeout)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _diff(self, before: dict, after: dict) -> list[tuple]:
        now = pd.Timestamp.now(tz="UTC").to_pydatetime()
        out = [(p, "create" if p not in before else "modify", now) for p in sorted(after) if before.get(p) != after[p]]
        return out + [(p, "delete", now) for p in sorted(before) if p not in after]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before = json.loads(start["files"])
        after = {p: [m, s] for p, m, s in list_files(self.root)} if os.path.exists(self.root) else {}
        return iter(self._diff(before, after)), {"files": json.dumps(after, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._diff(json.loads(start["files"]), json.loads(end["files"])))

    def commit(self, end: dict) -> None:
        pass


class DirectoryChanges(DataSource):
    """Stream of (path, event, ts) from the difference of directory listings; unlike file sources it sees deletes.

    The offset holds the listing, so it suits code trees on a file system the driver sees; larger feeds bring their own events.
    """

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"])


def watch(spark, root: str) -> DataFrame:
    """Stream of changes under a directory."""
    spark.dataSource.register(DirectoryChanges)
    return spark.readStream.format("directory_changes").option("path", root).load()


def handler(engine, gap: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps an engine up to date: the last event of each path in a batch counts.

    A batch waits until its newest event is ``gap`` seconds old and then looks at the files, so a burst that goes on in the
    meantime is read in its last state, and its later events find unchanged content.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("event", "ts").alias("event"), F.max(F.unix_millis("ts")).alias("ms"))
        last = actions(last).collect()  # changed paths of one micro-batch
        if last:
            sleep(min(gap, max(0.0, gap - (time.time() - max(r.ms for r in last) / 1000))))
        gone = [r.path for r in last if r.action == "delete" or not os.path.exists(r.path)]
        new = [r.path for r in last if r.path not in gone]
        if gone:
            engine.delete(gone)
        if new:
            engine.index_files(new)

    return apply


def start(engine, root: str, checkpoint: str, trigger: dict | None = None, gap: float = 0.5):
    """Start watching, with bursts of events debounced by ``gap`` seconds; returns the StreamingQuery."""
    return watch(engine.spark, root).writeStream.foreachBatch(handler(engine, gap)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
