import random
import re

import numpy as np
import pytest

from lodestack.llm import ngram_join


def brute(rows, k, num, den):
    """component_id and set size of every row by comparing all pairs."""
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                top[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, families=12, size=14, words=60, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(vocabulary)]
    shared = [rng.choice(vocab) for _ in range(30)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 10, words, 3 * words]))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t + (shared if rng.random() < 0.3 else [])))
    rng.shuffle(out)
    return list(enumerate(out))


EDGES = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x " * 30_000), (1007, "x " * 29_999), (1008, "a b c d")]


@pytest.mark.parametrize("k,num,exact,shingles,most", [(3, 90, False, ngram_join.BLOCK_SHINGLES, ngram_join.BLOCK_ROWS), (5, 80, False, 300, 1000), (3, 90, True, 10**6, 4), (5, 80, True, 10**6, 10**6)])
def test_equals_brute_force(spark, k, num, exact, shingles, most):
    rows = corpus(k) + EDGES
    rows = [r for r in rows if r[0] != 5] + [(5, "w1 w2 W3 W4 W5 W6 W8")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = df.selectExpr("*", "1 AS n_shingles", "'x' AS grp", "2 AS block", "'y' AS sh", "3 AS key", "4 AS f", "5 AS rep", "6 AS label")
    got = ngram_join.join(spark, extra, k, num, 100, exact=exact, block_shingles=shingles, block_rows=most)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, num, 100)


def test_rows_that_share_an_id_go_by_their_own_sets(spark):
    word = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, word("a")), (2, word("a")), (2, word("b")), (2, word("b")), (3, word("b") + " x"), (4, word("c"))]
    for most in (1, 1000):
        got = ngram_join.join(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, block_rows=most)
        assert sorted({(r.doc_id, r.component_id) for r in got.collect()}) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]


@pytest.mark.parametrize("num", [90, 80])
def test_search_equals_all_overlaps(num):
    """DivideSkip against plain intersections, with lists short and long, and while rows leave the index."""
    rng = random.Random(num)
    for _ in range(60):
        pool = [rng.getrandbits(64) for _ in range(rng.choice([12, 40, 300]))]
        base = rng.sample(pool, min(len(pool), 60))
        sets = []
        for _ in range(rng.choice([1, 5, 60])):
            own = set(base) if rng.random() < 0.7 else set(rng.sample(pool, rng.randint(1, len(pool))))
            for _ in range(rng.choice([0, 1, 3, 9])):
                own.discard(rng.choice(base))
                own.add(rng.choice(pool))
            sets.append(np.array(sorted(own), np.uint64))
        index, gone = ngram_join.Postings(sets), set()
        for q in sets:
            want = [(i, len(np.intersect1d(q, s))) for i, s in enumerate(sets) if i not in gone]
            want = [(i, o) for i, o in want if 100 * o >= num * (len(q) + len(sets[i]) - o)]
            assert sorted(index.search(q, num, 100)) == want
            if rng.random() < 0.3:
                index.remove([i for i, _ in want])
                gone |= {i for i, _ in want}


@pytest.mark.parametrize("num", [90, 80])
def test_proposals_find_pairs_at_the_threshold(num):
    """Recall of bands and prefixes over pairs whose similarity is exactly the threshold, as measured."""
    rng = np.random.default_rng(num)
    size = 200  # of the union
    pairs = []
    for _ in range(2000):
        h = np.unique(rng.integers(0, 1 << 63, size + 9, dtype=np.uint64))[:size]
        rng.shuffle(h)
        out = size * (100 - num) // 100
        cut = rng.integers(0, out + 1)
        pairs.append((np.sort(np.delete(h, slice(0, cut))), np.sort(np.delete(h, slice(cut, out)))))
    sets = [s for p in pairs for s in p]
    row, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    for rows in (None, ngram_join.STRICT_ROWS):
        keys = ngram_join._bands(row, flat, len(sets), *ngram_join.banding(num, 100, rows))
        shared = (keys[0::2] == keys[1::2]).sum(axis=1)
        assert shared.min() > 0
        assert abs((keys[0::2] == keys[1::2]).mean() - (num / 100) ** (rows or ngram_join.banding(num, 100)[1])) < 0.02  # bands match at the ideal rate
    offsets, keys = ngram_join._prefixes(row, flat, len(sets), num, 100)
    parts = np.split(keys, offsets[1:-1])
    assert all(len(np.intersect1d(a, b)) for a, b in zip(parts[0::2], parts[1::2]))
    assert [len(p) for p in parts] == [len(s) - -(-num * len(s) // 100) + 1 for s in sets]


def test_one_large_group_over_many_blocks(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(240):  # a chain of drifting copies and copies of its start
        t = list(base)
        t[rng.randrange(80)] = f"u{i}"
        rows.append((i, " ".join(t)))
        if i % 3 == 0:
            base[rng.randrange(80)] = f"v{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(spark, df, 3, 90, 100, block_rows=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 90, 100)


def test_empty_table(spark):
    assert ngram_join.join(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_miss_less_than_stated():
    for num in (80, 90, 95, 100):
        for want in (None, ngram_join.STRICT_ROWS):
            bands, rows = ngram_join.banding(num, 100, want)
            assert (1 - (num / 100) ** rows) ** bands <= ngram_join.MISS
