"""Quality rules, line dedup, BPE and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestack.llm import bpe, line_dedup, quality_rules, queries

from .test_mixing import fill
from .test_ngram_join import brute as near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(marked),
        "n_stop_words": sum(x in quality_rules.STOP_WORDS for x in w),
        "n_stutters": sum(a == b for a, b in zip(w, w[1:])),
        "n_lines": len(lines),
        "n_open_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    }


def good(c):
    if c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]:
        return False
    for r in quality_rules.DEFAULT_RULES:
        bottom = c[r.denominator] if r.denominator else 1
        x = c[r.numerator] / bottom if bottom else 0.0
        if (r.low is not None and x < r.low) or (r.high is not None and x > r.high):
            return False
    return True


def texts():
    rng = random.Random(2)
    vocab = "the of and le der el x### lorem…  a\x0bb é日本 AND. dolor... |".split(" ") + ["\n", "\t", "\r\n", " "]
    out = [None, "", " \n\t\x0c", "a", "the " * 50_000, "\n".join(["the same line of the text"] * 40), "x " * 7, "b " * 8, "c d " * 8, "end...\nof…\nthe ... \n" * 9]
    return out + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_quality_counts_equal_brute_force(spark):
    data = list(enumerate(texts())) + [(3, "a")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'q' AS n_words", "0 AS kept")
    got = quality_rules.measure(df).collect()
    assert len(got) == len(data)
    by_id = dict(data)
    for r in got:
        want = counts(by_id[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert r.kept == good(want)
    kept = quality_rules.apply(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.measure(df.limit(0)).collect() == []


def test_quality_plan_has_no_python(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op3_quality_rules(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def strip_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def dedup_lines(rows, least=20, docs=3):
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(strip_key(x)) >= least:
                held[strip_key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held[strip_key(x)]) >= docs and d != max(held[strip_key(x)]))]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def line_rows():
    rng = random.Random(8)
    pool = ["A line of more than twenty characters é", "  a LINE of more than twenty characters é\t", "short line", "", " ", "x" * 20, "é" * 19, "é" * 20, "\x0b" + "y" * 25 + "\r"] + [f"unique line number {i} of the pool" for i in range(60)]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    return out + [(500, None), (501, ""), (502, "\n\n"), (503, "z" * 3_000_000), (504, ("w" * 30 + "\n") * 40_000), (505, "w" * 30), (506, "W" * 30)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 4)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS h1", "'n' AS n_lines")
    got = line_dedup.dedup(spark, df, batches=batches, fanout=fanout, keep_cols=["doc_id", "h1"]).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest(), t) for d, n, k, t in dedup_lines(rows)]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.text) for r in got) == sorted(want)
    assert all(r.h1 == 7 for r in got)


def test_line_dedup_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(spark, df).collect() == []
    df = spark.createDataFrame([(1, "k" * 30)] * 4 + [(2, "k" * 30)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup(spark, df).collect()} == {0}  # two documents hold it


NAMES = ["h1", "h2", "batch", "keeper", "n_docs", "old", "in_0", "more", "e", "i", "_id", "id", "_drops", "drops", "n_lines", "N_Lines", "n_dropped", "kept_sha256", "__x"]


@pytest.mark.parametrize("names", [NAMES[0::2], NAMES[1::2]])
def test_line_dedup_takes_extra_columns_of_any_name(spark, names):
    data = [(d, "a line that all of them hold, as it is") for d in (1, 2, 3)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", *[f"doc_id * 7 AS {n}" for n in names])
    got = line_dedup.dedup(spark, df)
    rest = [n for n in names if n.lower() not in line_dedup.MADE]
    assert got.columns == ["doc_id", *rest, "text", "n_lines", "n_dropped", "kept_sha256"]
    rows = got.collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in rows} == {(1, 1, 1), (2, 1, 1), (3, 1, 0)}
    assert all(r[n] == r.doc_id * 7 for r in rows for n in rest)


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += "".join("b" if c == "a" else "a" for c in s)
    return s, "".join("b" if c == "a" else "a" for c in s)


def test_lines_and_words_with_equal_polynomials_differ(spark):
    from lodestack.llm import ngram_join

    s, c = thue_morse(10)
    for k in (1, 2048):  # lines of 1 KB, and of 2 MB
        df = spark.createDataFrame([(1, s * k), (2, s * k), (3, s * k), (9, c * k)], "doc_id long, text string")
        assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup(spark, df).collect()) == [(1, 1), (2, 1), (3, 0), (9, 0)]
        assert sorted((r.doc_id, r.component_id) for r in ngram_join.join(spark, df, 3, 90, 100).collect()) == [(1, 1), (2, 1), (3, 1), (9, 9)]


def test_span_hashes_do_not_depend_on_their_place():
    import numpy as np

    from lodestack.llm import bytehash as bh

    rng = random.Random(5)
    parts = [bytes(rng.randrange(32, 127) for _ in range(n)) for n in (0, 1, 7, 8, 9, 63, 64, 65, 1000, bh.SLICE - 1, bh.SLICE, bh.SLICE + 1, 2 * bh.SLICE + 5)]
    one = lambda p, salt=0, fold=True: int(bh.span_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]), salt, fold)[0])
    ends = np.cumsum([len(p) for p in parts])
    got = bh.span_hashes(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends).tolist()
    assert got == [one(p) for p in parts] == [one(p.lower()) for p in parts] and len(set(got)) == len(parts)
    assert one(parts[4], 1) != one(parts[4]) and one(b"A", 0, False) != one(b"a", 0, False) and one(b"a") != one(b"a\0")


def test_runs_take_new_keys_from_the_anti_join_alone(spark):
    from lodestack.llm.runtime import Workspace

    batches = [(9, (1, 2)), (8, (2, 3)), (7, (4,)), (6, (1, 5)), (5, (1, 3))]
    runs = line_dedup.LevelledRuns(Workspace(spark, "t"), fanout=2)
    held = set()
    for d, ks in batches:
        new = runs.add(spark.createDataFrame([(d, k, -k) for k in ks], "doc_id long, h1 long, h2 long"))
        assert {r.h1 for r in new.collect()} == set(ks) - held
        held |= set(ks)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = [r for run in runs.runs() for r in run.collect()]
    assert len(rows) == len(held)  # each key in one run
    assert {r.h1: r.keeper for r in runs.repeated(1).collect()} == {1: 9, 2: 9, 3: 8, 4: 7, 5: 6}
    assert {r.h1: r.keeper for r in runs.repeated(2).collect()} == {1: 9, 2: 9, 3: 8}
    assert {r.h1: r.keeper for r in runs.repeated(3).collect()} == {1: 9}

    batch = spark.createDataFrame([(1, 1, 4, 1)], "h1 long, h2 long, keeper long, n_docs long")
    with runs.buckets.in_order():
        plan = runs.split(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and len(re.findall(r"SortMergeJoin", plan)) == 2
    assert len(re.findall(r"\bSort \[", plan)) == len(re.findall(r"Exchange hashpartitioning", plan)) == 1  # the batch's own
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestack_lines")]


def test_runs_are_merged_in_their_order(spark):
    from lodestack.llm.runtime import Workspace

    rng = random.Random(8)
    runs = line_dedup.LevelledRuns(Workspace(spark, "t"), fanout=3)
    keeper, holders, shape = {}, defaultdict(int), []
    for d in range(60, 0, -6):
        rows = [(d - k, h, -h) for k in range(6) for h in rng.sample(range(-150, 150), 12)]
        new = runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
        assert {r.h1 for r in new.collect()} == {h for _, h, _ in rows} - set(keeper)
        for doc, h, _ in rows:
            keeper.setdefault(h, doc)
            holders[h] += 1
        shape.append([len(level) for level in runs.levels])
    assert shape == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2], [0, 0, 1], [1, 0, 1]]
    assert sorted(r.h1 for run in runs.runs() for r in run.collect()) == sorted(keeper)
    for n in (1, 3, 8):
        assert {r.h1: r.keeper for r in runs.repeated(n).collect()} == {h: keeper[h] for h in keeper if holders[h] >= n}

    runs.add(spark.createDataFrame([(0, h, -h) for h in range(200, 260)], "doc_id long, h1 long, h2 long"))
    a, b = [run for _, run in runs.levels[0]]
    with runs.buckets.in_order():
        merged = runs.merge(a, b)
        for plan, kind, joins in ((merged, "FullOuter", 1), (runs.split(a), "LeftAnti", 3)):
            plan = plan._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(rf"SortMergeJoin .*{kind}", plan)) == joins and plan.count("Bucketed: true") == joins + 1
            assert "Exchange" not in plan and not re.search(r"\bSort \[", plan)
        parts = merged.rdd.map(lambda r: (r.h1, r.h2)).glom().collect()
    assert len(parts) == runs.buckets.n and all(p == sorted(p) for p in parts)
    assert sorted(x for p in parts for x in p) == sorted((r.h1, r.h2) for run in (a, b) for r in run.collect())
    runs.close()


def test_line_dedup_query_fills_levels_and_meets_merged_runs(spark, sf, monkeypatch):
    steps = []

    class Watched(line_dedup.LevelledRuns):
        def add(self, keys):
            met = len(self.runs())
            new = super().add(keys)
            steps.append((met, [len(level) for level in self.levels]))
            return new

    monkeypatch.setattr(line_dedup, "LevelledRuns", Watched)
    queries.op10_line_dedup(spark, sf)
    assert steps == [(0, [1]), (1, [0, 1]), (1, [1, 1]), (2, [0, 0, 1])]


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(path, public_tokenizers.PATTERN).ranks, special_tokens={})


def test_bpe_equals_the_library(spark, encoding):
    path, pattern, enc = encoding
    rng = random.Random(3)
    data = [None, "", " ", "a" * 30_000, "é漢字🙂" * 900, "  \x85 x　y", "!!!" * 2000, "<|endoftext|>"]
    data += ["".join(rng.choice("ab \n\t'sé漢🙂1٣²! \x1c\x1f\x85tionthe") for _ in range(rng.randint(1, 900))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(data)) + [(3, data[3])], "doc_id long, text string").selectExpr("*", "'q' AS ids", "1 AS n_tokens")
    got = bpe.encode(df, path, pattern).collect()
    assert len(got) == len(data) + 1
    for r in got:
        t = data[r.doc_id] or ""
        want = enc.encode_ordinary(t)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(df.limit(0), path, pattern).collect() == []


def test_bpe_long_pieces(encoding):
    path, pattern, enc = encoding
    rng = random.Random(6)
    letters = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    pieces = [letters(n, al) for al in ("ab", "theofand", "é漢字🙂a", "abcdefghijklmnopqrstuvwxyz") for n in (1, 2, 63, 64, 65, 129, 1000, 4096, 4097, 20_000)]
    pieces += ["a" * n for n in (63, 64, 65, 4097, 300_000)]
    got = bpe.load(path, pattern).encode_batch(pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(x) for x in pieces]


def test_bpe_order_of_merges_under_any_ranks(tmp_path):
    """Ranks in no order of length, so that merges keep making pairs of lower rank."""
    import base64

    import tiktoken

    for seed in range(40):
        rng = random.Random(seed)
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(60)}
        ranks = list(range(256, 256 + len(tokens)))
        rng.shuffle(ranks)
        vocab = {bytes([b]): b for b in range(256)} | dict(zip(sorted(tokens), ranks))
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in vocab.items()))
        enc = tiktoken.Encoding(f"own{seed}", pat_str=r"[^ ]+| ", mergeable_ranks=vocab, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (*range(1, 40), 70, 150, 700)] + ["a" * 99, "abc" * 50, "aab" * 33]
        got = bpe.BytePairs(str(path), r"[^ ]+| ").encode_batch(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]


def test_pipeline_stages_against_brute_force(spark, sf, encoding):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(map(tuple, docs.select(*corpus_pipeline.COLUMNS).collect()))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        got = sorted(map(tuple, out.collect()), key=str) if k == 4 else sorted(map(tuple, out.collect()))
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        if k == 0:
            assert got == [r for r in rows if good(counts(r[1]))]
        if k == 1:
            text = {d: t for d, _, _, t in dedup_lines([r[:2] for r in rows])}
            assert got == [(r[0], text[r[0]], r[2], r[3], len(text[r[0]])) for r in rows]
        if k == 2:
            first = {d for d, _, c in near_copies([r[:2] for r in rows], 5, 80, 100) if d == c}
            assert got == [r for r in rows if r[0] in first] and len(got) < len(rows)
        if k == 3:
            size = {r[0]: len(WORD.findall(r[1])) for r in rows}
            total, taken, top = defaultdict(int), defaultdict(int), defaultdict(int)
            for r in rows:
                total[r[3]] += size[r[0]]
                top[r[3]] = max(top[r[3]], size[r[0]])
            for r in got:
                taken[r[3]] += size[r[0]]
            assert set(got) <= set(rows)
            assert all(abs(taken[s] - t) <= top[s] + 1e-6 for s, t in fill(total).items())
        if k == 4:
            ids = sorted((r[0], encoding[2].encode_ordinary(r[1])) for r in rows)
            at = out.columns.index("ids")
            assert sorted((r[0], r[at]) for r in got) == ids
        rows = got
        docs = spark.createDataFrame(out.collect(), out.schema) if k < 4 else docs
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r[0], r[out.columns.index("ids_sha256")]) for r in rows)
