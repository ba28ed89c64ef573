from collections import defaultdict

import pytest

from lodestack.llm import mixing


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Water filling by repeated resharing, over {source: size}."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over
    return out


def rows():
    out = []
    for i in range(900):
        s = ["hot", "a", "b", "tiny", None, "é", "Z"][min(6, i % 13)]
        s = "hot" if i % 13 > 6 else s
        if s == "tiny" and i > 100:
            s = "hot"
        out.append((i, " ".join(["w"] * (i * 37 % 91)) if i % 50 else None, s))
    return out + [(2000, "x " * 40_000, "a"), (2001, " \t\n", "b"), (2002, "q r s", "b"), (2002, "q r s", "b")]


@pytest.mark.parametrize("bucket", [mixing.BUCKET, 8])
def test_targets_and_rounding(spark, bucket):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.report(spark, df, bucket=bucket).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    want = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.report(spark, df.repartition(5), bucket=bucket).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("cap", [3, 1.2])
def test_targets_of_many_sources(spark, cap):
    from lodestack.llm.runtime import Workspace

    sizes = {f"s{i * 7919 % 1000:03}": (i * i * 31 + 7) % 4000 for i in range(400)} | {None: 50, "": 0, "é": 10**9, "🙂": 1}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_docs long, source_size long")
    got = mixing.targets(df, Workspace(spark, "t"), cap=cap, part_rows=37).collect()
    want = fill(sizes, cap=cap)
    assert {r.source: r.target for r in got} == {s: pytest.approx(t) for s, t in want.items()} and len(got) == len(sizes)


def test_expectation_of_a_document(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.report(spark, df, weights=(1, 1)).collect()
    a = [r for r in got if r.source == "a"]
    assert abs(sum(r.copies for r in a) / len(a) - a[0].target / a[0].source_size) < 0.03


def test_apply_repeats_rows(spark):
    data = rows()[:-1]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "doc_id AS copies", "1 AS _ordinal")
    out = mixing.apply(spark, df)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
        assert r.copies == r.doc_id
    want = defaultdict(int)
    for r in mixing.report(spark, df.drop("copies")).collect():
        want[r.doc_id] += r.copies
    assert {k: v for k, v in want.items() if v} == dict(count)


def test_apply_gives_equal_rows_and_shared_ids_their_own_copies(spark):
    data = [(1, "a b c", "s", "x")] * 5 + [(1, "a b c", "s", "y"), (1, "d e", "s", "x"), (None, "f g", "s", None), (None, "f g", "s", None), (None, None, "s", "f g"), (7, "h " * 50, "t", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, `a.b` string")
    out = mixing.apply(spark, df)
    got = out.collect()
    assert out.columns == df.columns and {tuple(r) for r in got} <= set(data)
    size = lambda s: sum(len((r.text or "").split()) for r in got if r.source == s)
    want = fill({"s": 24, "t": 50})
    assert all(abs(size(s) - want[s]) <= {"s": 3, "t": 50}[s] for s in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.report(spark, df).collect() == [] and mixing.apply(spark, df).collect() == []
