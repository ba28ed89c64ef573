"""Language id, ordinal quality and unigram counts: held-out accuracy and brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import language_id, ordinal_quality, queries, unigram_count

SMALL = "/root/testdata/sf0.01"
EDGES = [(9001, None), (9002, ""), (9003, "123 !? \n"), (9004, "é"), (9005, "x"), (9006, "der " * 60_000), (9006, "der " * 60_000)]


def test_language_held_out_accuracy(spark):
    got = queries.op7_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(docs, max_docs=300)
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'q' AS score", "'z' AS lang_pred", "1 AS threshold")
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9003].score == 0 and not got[9003].accepted
    assert got[9006].lang_pred == "de" and got[9004].lang_pred in model.languages and got[9005].threshold == 1
    assert language_id.predict(df.limit(0), model).collect() == []
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


def test_rare_languages_are_trained_on(spark):
    words = {"en": "the house and the river of", "de": "das Haus und der Fluss von", "eo": "ĉiuj ŝipoj ĝuas ĵaŭdon"}
    hashed = {r.id: r.h for r in spark.range(2400).select("id", F.xxhash64("id").alias("h")).collect()}
    order = sorted(hashed, key=hashed.get)
    lang = ["eo" if i in order[-2:] else "en" if i % 3 else "de" for i in range(2400)]  # eo is not among the lowest hashes
    docs = spark.createDataFrame([(i, f"{words[g]} {words[g]} {i}", g) for i, g in enumerate(lang)], "doc_id long, text string, lang string")
    got = language_id.sample(docs, 300).collect()
    for g, n in (("eo", 2), ("de", 149), ("en", 149)):
        assert {r.doc_id for r in got if r.lang == g} == set([i for i in order if lang[i] == g][:n])
    model = language_id.fit(docs, max_docs=300)
    assert model.languages == ["de", "en", "eo"]
    assert language_id.predict(spark.createDataFrame([(1, words["eo"])], "doc_id long, text string"), model).first().lang_pred == "eo"
    assert language_id.shares({"a": 9, "b": 1, "c": 9}, 2) == {"b": 1, "a": 1, "c": 1} and language_id.shares({"a": 9, "b": 1}, 6) == {"b": 1, "a": 5}


def test_training_reads_whole_texts(spark):
    for text in ("", "a", "é" * 31, "é" * 32, "aé" * 100, "x" * 257, "日本" * 5000):
        raw = text.encode()
        cut = language_id.parts(raw)
        assert b"".join(cut) == raw and all(p.decode() for p in cut) and len(cut) <= language_id.PARTS
    tail = "zwölf große Füße läuft über"
    docs = [(i, ("the house of " * 40) + (tail if i % 2 else "and so on"), "xx" if i % 2 else "en") for i in range(120)]  # told apart by the end alone
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = language_id.predict(spark.createDataFrame([(1, tail)], "doc_id long, text string"), model).first()
    assert got.lang_pred == "xx"


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [("a", 1, 50), ("a", 2, 60), ("a", 3, 50), ("b", 4, 400), ("b", 5, 300)]
    assert language_id.within(rows, 200) == {("a", 1), ("a", 3), ("b", 5)}
    assert language_id.within(rows, 2000) == {(g, k) for g, k, _ in rows}
    docs = spark.createDataFrame([(i, "der Fluss " * (1 if i < 50 else 10_000), "de") for i in range(60)] + [(99, "the river", "en")], "doc_id long, text string, lang string")
    assert language_id.fit(docs, max_bytes=4000).languages == ["de", "en"]


def plain_buckets(text):
    """Buckets of a text's n-grams, one by one."""
    folded = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    folded = [b if b >= 128 or 97 <= b <= 122 else 32 for b in folded]
    out = []
    for n in language_id.ORDERS:
        for i in range(len(folded) - n + 1):
            h = n
            for b in folded[i : i + n]:
                h = (h ^ b) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            out.append(h % language_id.BUCKETS)
    return out


def test_language_scores_are_means_of_features(spark):
    import pyarrow as pa

    from lodestack.llm import bytehash as bh

    texts = ["Abc dé", "x", "", "long " * 80_000, "y z"]
    model = language_id.train([("a", b"abc abc abd"), ("b", b"xyz xzy zzz")] * 20)
    buf, starts, ends = bh.column(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t")
    got = language_id.scores(model, buf, starts, ends)
    for k, t in enumerate(texts):
        f = np.array(plain_buckets(t if k != 3 else t[:5000]), np.int64)
        assert k == 3 or sorted(f) == sorted(language_id.features(t.encode()))
        if k == 3:
            f = language_id.features(t.encode())
        want = (model.table[f].mean(axis=0, dtype=float) if len(f) else 0) + model.bias
        assert got[k] == pytest.approx(want, abs=1e-5)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = ordinal_quality.fit(docs, labels.filter(~fold).select("doc_id", grade.alias("grade")))
    assert (np.diff(model.theta) > 0).all()
    held = labels.filter(fold).select("doc_id", grade.alias("grade"))
    got = ordinal_quality.score(docs, model).join(F.broadcast(held), "doc_id").collect()
    kept = {g: np.mean([r.kept for r in got if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.98 and kept[1] < 0.35 and kept[0] < 0.1
    mean = {g: np.mean([r.expected_grade for r in got if r.grade == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]


def test_quality_features_and_scores_equal_a_plain_count(spark):
    """Presence and density of words and beginnings, shape bins, and scores, without the module's vector code."""
    import re

    from lodestack.llm import bytehash as bh

    texts = ["", "One two, two THREE!", "été 123 #tags#\n\nlonger-words and\tAND and", "x" * 3000, "word " * 400 + "Other", "§§ ## $$"]
    one = lambda b, salt: int(bh.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), salt)[0]) >> (64 - ordinal_quality.BITS)
    size = 1 << ordinal_quality.BITS
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(b) for b in raw])
    row, feat, val = ordinal_quality.featurize(np.frombuffer(b"".join(raw), np.uint8), ends - [len(b) for b in raw], ends)
    for k, b in enumerate(raw):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", b)
        times = {}
        for w in words:
            for salt, cut in enumerate((None, *ordinal_quality.PREFIXES), 1):
                f = one(w[:cut], salt)
                times[f] = times.get(f, 0) + 1
        want = {f: 0.05 for f in times} | {size + f: min(1.0, 60 * n / max(len(words), 20)) for f, n in times.items()}
        mine = {int(f): float(v) for f, v in zip(feat[row == k], val[row == k])}
        shape = [f for f in mine if f >= 2 * size]
        assert {f: v for f, v in mine.items() if f < 2 * size} == pytest.approx(want) and 1 <= len(shape) <= 7 and all(mine[f] == 1 for f in shape)

    rng = np.random.default_rng(4)
    model = ordinal_quality.Model(rng.normal(0, 1, 3 * size).astype(np.float32), np.array([-0.5, 0.75]))
    got = {r.doc_id: r for r in ordinal_quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k in range(len(texts)):
        s = float((model.weights[feat[row == k]].astype(float) * val[row == k]).sum())
        low = [1 / (1 + np.exp(-min(40, max(-40, t - s)))) for t in model.theta]
        assert got[k].expected_grade == pytest.approx(2 - sum(low), abs=1e-4) and got[k].tail_probability == pytest.approx(1 - low[1], abs=1e-4)
        assert got[k].kept == (got[k].tail_probability >= 0.5)


def test_ordinal_likelihood_falls_along_the_steps():
    """Each step follows the gradient of the cumulative-link likelihood, computed here by differences."""
    rng = np.random.default_rng(1)
    rows = [(int(y), np.array([0, 1 + int(y), 4]), rng.random(3)) for y in rng.integers(0, 3, 400)]

    def loss(m):
        s = np.array([(m.weights[f] * v).sum() for _, f, v in rows])
        low = np.concatenate([np.zeros((len(s), 1)), m.at_most(s), np.ones((len(s), 1))], axis=1)
        y = np.array([r[0] for r in rows])
        return -np.log(low[np.arange(len(y)), y + 1] - low[np.arange(len(y)), y]).mean()

    found = [loss(ordinal_quality.train(rows, epochs=e, l2=0)) for e in (0, 1, 4, 16, 60)]
    assert all(a > b for a, b in zip(found, found[1:]))
    best = ordinal_quality.train(rows, epochs=400, l2=0)
    for f in (0, 1, 2, 3, 4):  # near the optimum no weight has a slope left
        for e in (-0.05, 0.05):
            w = best.weights.copy()
            w[f] += e
            assert loss(ordinal_quality.Model(w, best.theta)) > loss(best) - 2e-3


def test_quality_sample_is_bounded_in_bytes(spark):
    assert ordinal_quality.within([("a", 5), ("b", 9), ("c", 4), ("d", 1)], 10) == ["a", "c", "d"]
    docs = spark.createDataFrame([(i, "good words here " * (1 + i)) for i in range(30)], "doc_id long, text string")
    grades = docs.selectExpr("doc_id", "doc_id % 3 AS grade")
    assert not ordinal_quality.fit(docs, grades, max_bytes=0).weights.any()
    assert ordinal_quality.fit(docs, grades).weights.any()


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("kept", F.lit("x"))
    none = ordinal_quality.fit(df, spark.createDataFrame([], "doc_id long, grade int"))
    got = ordinal_quality.score(df, none).collect()
    assert len(got) == len(EDGES) and all(0 <= r.tail_probability <= 1 for r in got)
    one = ordinal_quality.fit(df, spark.createDataFrame([(9004, 2), (9004, 1), (9001, None), (None, 1), (1, 0)], "doc_id long, grade int"))
    assert len(ordinal_quality.score(df, one).collect()) == len(EDGES)
    assert ordinal_quality.score(df.limit(0), none).collect() == []


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    rows = [(int(y), np.array([int(y), 3], np.int32), np.ones(2, np.float32)) for y in rng.integers(0, 3, 300)]
    model = ordinal_quality.train(rows, epochs=30)
    low = model.at_most(np.array([model.weights[[y, 3]].sum() for y in range(3)]))
    p = np.diff(np.concatenate([np.zeros((3, 1)), low, np.ones((3, 1))], axis=1), axis=1)
    assert (p.argmax(axis=1) == [0, 1, 2]).all()


TEXTS = ["", "a", "  x  y ", "日本語🙂 x", "ßéñ\n\n\ttab", "▁▁ x▁y", "\x00\x01", "hello world " * 3000, "x" * 5000, "éé🙂🙂"]


def test_unigram_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    unigram = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").selectExpr("*", "'x' AS n_tokens")
    got = {r.doc_id: r.n_tokens for r in unigram_count.count(df, path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(unigram.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0), t[:40]
    assert got[len(texts)] == 0
