"""Debouncing and unchanged-content filtering, as tables and as streams."""

import datetime as dt
import random

from lodestack.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def events():
    rng = random.Random(6)
    out, t = [], T0
    for i in range(300):
        t += dt.timedelta(milliseconds=rng.choice([10, 100, 400, 900, 3000]))
        out.append((f"p{rng.randint(0, 4)}", rng.choice(["create", "modify", "delete", None]), t, i))
    return out


def sessions(rows, gap):
    out = []
    for path in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == path and r[1]), key=lambda r: (r[2], r[3]))
        burst = []
        for r in mine:
            if burst and r[2] - burst[-1][2] > gap:
                out.append((path, burst[-1][1], len(burst)))
                burst = []
            burst.append(r)
        if burst:
            out.append((path, burst[-1][1], len(burst)))
    return sorted(out)


SCHEMA = "path string, event string, ts timestamp, seq long"


def test_debounce_table(spark):
    rows = events()
    got = changes.debounce(spark.createDataFrame(rows, SCHEMA), order_col="seq").collect()
    assert sorted((r.path, r.event, r.n_events) for r in got) == sessions(rows, dt.timedelta(milliseconds=500))


def test_debounce_stream_equals_table_on_closed_sessions(spark, tmp_path):
    rows = events() + [("zz", "modify", T0 + dt.timedelta(days=1), 999)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    q = changes.debounce(stream, watermark="10 seconds", order_col="seq").writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.path, r.event, r.n_events) for r in spark.table("debounced").collect())
    assert got == [s for s in sessions(rows, dt.timedelta(milliseconds=500)) if s[0] != "zz"]


def test_skip_unchanged(spark, tmp_path):
    src = str(tmp_path / "in")
    batches = [[("a", "1", "create", 1), ("b", "1", "create", 2), ("a", "1", "modify", 3)], [("a", "1", "modify", 4), ("b", "2", "modify", 5)], [("b", None, "delete", 6), ("b", "2", "create", 7), ("a", "2", "modify", 8)]]
    schema = "path string, md5 string, event string, seq long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    q = changes.skip_unchanged(stream).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seq for r in spark.table("fresh").collect()) == [1, 2, 5, 6, 7, 8]


def test_classes_and_actions(spark):
    df = spark.createDataFrame([("CREATE|WRITE",), ("WRITE",), ("REMOVE",), ("RENAME",), ("WRITE|REMOVE",)], "op string")
    assert [r.e for r in df.select(changes.classify(df.op).alias("e")).collect()] == ["create", "modify", "delete", None, "modify"]
    got = changes.actions(spark.createDataFrame([("a", "delete"), ("b", "create")], "path string, event string")).collect()
    assert [r.action for r in got] == ["delete", "index"]


def test_handler_waits_for_a_burst_to_end(spark, tmp_path):
    import time

    calls, waits = [], []

    class Engine:
        def delete(self, paths):
            calls.append(("delete", sorted(paths)))

        def index_files(self, paths):
            calls.append(("index", sorted(paths)))

    there, gone = tmp_path / "a.py", tmp_path / "b.py"
    there.write_text("x")
    now = dt.datetime.fromtimestamp(time.time(), dt.timezone.utc)
    rows = [(str(there), "create", now - dt.timedelta(seconds=3)), (str(there), "modify", now), (str(gone), "modify", now)]
    apply = changes.handler(Engine(), gap=60, sleep=waits.append)
    apply(spark.createDataFrame(rows, "path string, event string, ts timestamp"), 0)
    assert calls == [("delete", [str(gone)]), ("index", [str(there)])] and 30 < waits[0] <= 60
    apply(spark.createDataFrame([(str(there), "modify", now - dt.timedelta(hours=1))], "path string, event string, ts timestamp"), 1)
    assert waits[1] == 0 and len(calls) == 3


def test_directory_listing_differences(tmp_path):
    reader = changes._Reader(str(tmp_path))
    first, offset = reader.read(reader.initialOffset())
    assert list(first) == []
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "b.xyz").write_text("x")
    rows, after = reader.read(offset)
    assert [(r[0].rsplit("/")[-1], r[1]) for r in rows] == [("a.py", "create")]
    assert [(r[0], r[1]) for r in reader.readBetweenOffsets(after, offset)] == [(str(tmp_path / "a.py"), "delete")]
