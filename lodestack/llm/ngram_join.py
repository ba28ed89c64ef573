"""N-gram Jaccard join by T-occurrence search (DivideSkip), reported as connected components.

Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets A, B of distinct k-word shingles.

1. Documents with equal sets form a class (128-bit fingerprint); its smallest id stands for it.
2. Proposals decide who is searched together, never who links. By default they are min-hash bands whose miss probability for a
   pair at the threshold is below ``MISS`` (1e-12): documents that share no band key with another have no link, the others are
   banded again with ``STRICT_ROWS`` rows a band (same bound), and connected proposals form a search group. With
   ``exact`` the keys are each set's prefix instead: the smallest ``|A| - ceil(t |A|) + 1`` hashes, of which every linked pair
   shares one; it misses nothing and proposes more.
3. Inside a group an inverted index answers T-occurrence searches by DivideSkip: the T-driven number of longest lists is set
   aside, the short ones are merged on a heap that skips what cannot reach the rest of T, and the survivors are looked up in
   the long ones by binary search. Found documents leave the index, so a dense group costs about one pass over its postings.
4. Groups are cut into blocks of bounded rows and shingles (most are one block). Each block finds its own links and a cover of
   stars (a centre and documents linked to it). Linked centres join blocks first, which leaves most groups in one piece. As
   Jaccard distance is a metric, a link between the pieces left needs a document within two link distances of the other's
   centre: the documents search the centres of other pieces, and the few in a centre's ring search the centre's block. No step
   lists the pairs of a group, and no task holds more than a block, a chunk of centres or of queries.

Edge cases: null, empty or blank text has an empty set and links with nothing; a text with fewer than k words has one
shingle, the whole sequence; very long texts are one set each; rows that share an id have the component
of their own set each (sets that one id names as the smallest of both count as one); a row without an id has no component of
its own (null, or that of its copies); ties don't occur (ids are compared); an empty table gives an
empty result; extra columns are ignored. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash as bh
from .components import components
from .runtime import Workspace

MISS = 1e-12
STRICT_ROWS = 8
BLOCK_SHINGLES = 1_000_000  # of a block, a chunk of star centres, or of queries
BLOCK_ROWS = 2_000
HEAP_POSTINGS = 1_000  # up to here short lists are merged row by row, beyond as arrays; the counts are the same


def banding(num: int, den: int, rows: int | None = None) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares no band with probability under MISS."""
    t = num / den
    if t >= 1:
        return 1, 1
    rows = rows or (4 if t >= 0.85 else 3)
    return ceil(log(MISS) / log(1 - t**rows)), rows


def _bands(row: np.ndarray, h: np.ndarray, n_rows: int, bands: int, rows: int) -> np.ndarray:
    """Band keys of each row (n_rows x bands); rows without shingles get zeros."""
    out = np.zeros((n_rows, bands), np.uint64)
    have, first = np.unique(row, return_index=True)
    if not len(have):
        return out
    with np.errstate(over="ignore"):
        seeds = bh.mix(np.arange(1, bands * rows + 1, dtype=np.uint64), 0xABCDEF).reshape(bands, rows)
        for b in range(bands):
            key = np.full(len(have), b + 1, np.uint64)
            for r in range(rows):
                v = ((h ^ seeds[b, r]) * (seeds[b, r] | np.uint64(1))) >> np.uint64(32)
                key = bh.mix(key * np.uint64(0x100000001B3) + np.minimum.reduceat(v.astype(np.uint32), first).astype(np.uint64))
            out[have, b] = key
    return out


def _prefixes(row: np.ndarray, h: np.ndarray, n_rows: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, keys): of each row's sorted hashes the smallest |A| - ceil(t |A|) + 1."""
    n = np.bincount(row, minlength=n_rows)
    take = np.where(n > 0, n - -(-num * n // den) + 1, 0)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    return np.concatenate([[0], np.cumsum(take)]), h[place < take[row]]


def _profile(k: int, num: int, den: int, exact: bool):
    bands, rows = banding(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = bh.column(batch, "text")
            for i, j in bh.groups(starts, ends):
                row, h = bh.shingles(buf, starts[i:j], ends[i:j], k)
                n = np.bincount(row, minlength=j - i)
                have, first = np.unique(row, return_index=True)
                fp = np.zeros((2, j - i), np.uint64)
                with np.errstate(over="ignore"):
                    for s in (0, 1):
                        if len(have):
                            fp[s, have] = np.add.reduceat(bh.mix(h, 0x1234567 + s), first)
                if exact:
                    offsets, keys = _prefixes(row, h, j - i, num, den)
                else:
                    offsets, keys = np.arange(0, (j - i + 1) * bands, bands), _bands(row, h, j - i, bands, rows).ravel()
                keys = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), keys], names=["doc_id", "n_shingles", "f1", "f2", "keys"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = bh.column(batch, "text")
            for i, j in bh.groups(starts, ends):
                row, h = bh.shingles(buf, starts[i:j], ends[i:j], k)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "sh"])

    return run


class Postings:
    """Inverted lists over a bounded number of shingle sets, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.sets = sets
        self.live = np.ones(len(sets), bool)
        self._build()

    def _build(self) -> None:
        on = np.flatnonzero(self.live)
        tokens = np.concatenate([self.sets[i] for i in on]) if len(on) else np.zeros(0, np.uint64)
        owner = np.repeat(on, self.sizes[on])
        order = np.argsort(tokens, kind="stable")  # owners ascend inside a list
        tokens, self.rows = tokens[order], owner[order]
        self.owner = self.rows.tolist()
        self.vocabulary, self.first = np.unique(tokens, return_index=True)
        self.end = np.append(self.first[1:], len(tokens))
        self.built = len(on)

    def remove(self, rows: list[int]) -> None:
        self.live[rows] = False
        if self.live.sum() * 2 < self.built:
            self._build()

    def _merge_skip(self, lists: list[tuple[int, int]], need: int) -> list[tuple[int, int]]:
        """(row, count) of the rows that ``need`` or more of the lists (first, end) hold, by a heap over the lists' heads.

        Where the smallest row is in too few lists, the next smallest heads up to need - 1 lists are taken off too, and all of
        them jump to the row that is smallest then: no row before it can be in enough lists.
        """
        owner, out = self.owner, []
        heap = [(owner[a], a, b) for a, b in lists]
        heapify(heap)
        while len(heap) >= need:
            row, taken = heap[0][0], []
            while heap and heap[0][0] == row:
                taken.append(heappop(heap))
            if len(taken) >= need:
                out.append((row, len(taken)))
                for _, a, b in taken:
                    if a + 1 < b:
                        heappush(heap, (owner[a + 1], a + 1, b))
                continue
            while heap and len(taken) < need - 1:
                taken.append(heappop(heap))
            if not heap:
                break
            top = heap[0][0]
            for _, a, b in taken:
                a = bisect_left(owner, top, a, b)
                if a < b:
                    heappush(heap, (owner[a], a, b))
        return out

    def _merge_runs(self, lists: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts) of many postings: a heap over the lists gives the two shortest, which are merged as arrays."""
        heap = [(b - a, i, self.rows[a:b], np.ones(b - a, np.int64)) for i, (a, b) in enumerate(lists)]
        heapify(heap)
        while len(heap) > 1:
            (_, i, r, c), (_, _, r2, c2) = heappop(heap), heappop(heap)
            r, c = np.concatenate([r, r2]), np.concatenate([c, c2])
            order = np.argsort(r, kind="stable")  # of two sorted runs: one merge
            r, c = r[order], c[order]
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            heappush(heap, (len(head), i, r[head], np.add.reduceat(c, head)))
        return heap[0][2:]

    def search(self, query: np.ndarray, num: int, den: int, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(row, overlap) of the live (and ``wanted``) sets whose Jaccard similarity with ``query`` is num / den or more."""
        m = len(query)
        if not m or not len(self.vocabulary):
            return []
        at = np.searchsorted(self.vocabulary, query)
        at[at == len(self.vocabulary)] = 0
        at = at[self.vocabulary[at] == query]
        least = max(1, -(-num * m // den))  # T: what any set of a size that can link must share
        if len(at) < least:
            return []
        length = self.end[at] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        lists = list(zip(self.first[at].tolist(), self.end[at].tolist()))
        longest = lists[-1][1] - lists[-1][0]
        n_long = min(least - 1, int(least / (0.01 * log(longest + 1) + 1))) if longest > 8 else 0
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        if sum(b - a for a, b in short) <= HEAP_POSTINGS:
            got = self._merge_skip(short, least - n_long)
            rows, seen = (np.array(x, np.int64) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        else:
            rows, seen = self._merge_runs(short)
        size = self.sizes[rows]
        fit = (seen >= least - n_long) & self.live[rows] & (den * size >= num * m) & (den * m >= num * size)
        if wanted is not None:
            fit &= wanted[rows]
        rows, seen = rows[fit], seen[fit]
        if len(rows) <= 8:
            return self._probe_each(rows.tolist(), seen.tolist(), long_, m, least, num, den)
        for left, (a, b) in zip(range(n_long - 1, -1, -1), long_):
            items = self.rows[a:b]
            p = np.searchsorted(items, rows)
            p[p == len(items)] = 0
            seen = seen + (items[p] == rows)
            if left % 16 == 0:  # what is left can no longer reach T
                on = seen + left >= least
                rows, seen = rows[on], seen[on]
        hit = den * seen >= num * (m + self.sizes[rows] - seen)
        return list(zip(rows[hit].tolist(), seen[hit].tolist()))

    def _probe_each(self, rows: list[int], counts: list[int], long_: list[tuple[int, int]], m: int, least: int, num: int, den: int) -> list[tuple[int, int]]:
        owner, out = self.owner, []
        for row, seen in zip(rows, counts):
            left = len(long_)
            for a, b in long_:
                if seen + left < least:
                    break
                left -= 1
                x = bisect_left(owner, row, a, b)
                seen += x < b and owner[x] == row
            if den * seen >= num * (m + int(self.sizes[row]) - seen):
                out.append((row, seen))
        return out


def link_group(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, centre) of each set: the first row of its component, and a row it is linked to that heads a star (or itself)."""
    n = len(sets)
    label, centre = np.full(n, -1), np.full(n, -1)
    index = Postings(sets)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        index.remove([seed])
        queue = deque([seed])
        while queue:
            x = queue.popleft()
            if centre[x] < 0:
                centre[x] = x
            found = [row for row, _ in index.search(sets[x], num, den)]
            if found:
                label[found] = seed
                if centre[x] == x:
                    centre[found] = x
                index.remove(found)
                queue.extend(found)
    return label, centre


def _keyed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal keys as one table; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _cells(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column(name).to_pylist()]


def _strict_keys(bands: int, rows: int):
    """(doc_id, key) of stored sets under a stricter banding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x) // 8 for x in batch.column(1).to_pylist()])
            i = 0
            while i < batch.num_rows:
                before = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, before + 200_000, side="right")))
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).slice(i, j - i).to_pylist()]
                row = np.repeat(np.arange(j - i), [len(x) for x in sets])
                keys = _bands(row, np.concatenate(sets), j - i, bands, rows)
                ids = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.ravel().view(np.int64))], names=["doc_id", "key"])
                i = j

    return run


def _proposals(keys: DataFrame) -> DataFrame:
    """Edges (src, dst) from each document to the smallest one that shares a band key with it.

    Keys are counted map-side, however hot; the mask gives the small side an exchange of its own, so a hot key can be split.
    """
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("top")).filter("top > m")
    shared = shared.select(F.col("key").bitwiseXOR(F.lit(0).cast("long")).alias("_key"), "m")
    found = keys.join(shared, F.col("key") == F.col("_key")).filter(F.col("m") != F.col("doc_id"))
    return found.select(F.col("doc_id").alias("src"), F.col("m").alias("dst")).distinct()


def _dealt(rows: DataFrame, keys: list[str], name: str, shingles: int, most_rows: int) -> DataFrame:
    """The number ``name`` of parts that the rows of each key are cut into, so that a part has bounded rows and shingles.

    The keys are masked, so that a join can split the rows of a large key over tasks."""
    n = F.greatest(F.ceil(F.sum(F.length("sh")) / F.lit(8 * shingles)), F.ceil(F.count(F.lit(1)) / F.lit(most_rows))).cast("int")
    return rows.groupBy(*keys).agg(n.alias(name)).select(*[F.col(k).bitwiseXOR(F.lit(0).cast(t)).alias(f"_{k}") for k, t in zip(keys, ("bigint", "int"))], name)


def _blocked(sets: DataFrame, shingles: int, rows: int) -> DataFrame:
    """Sets (grp, doc_id, sh) with the number of blocks of their group and their own block."""
    sizes = _dealt(sets, ["grp"], "blocks", shingles, rows)
    out = sets.select("grp", "doc_id", "sh").join(sizes, F.col("grp") == F.col("_grp")).drop("_grp")
    return out.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def _link_blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block), table in _keyed(batches, ["grp", "block"]):
            table = table.sort_by("doc_id")
            ids = table.column("doc_id").to_numpy()
            label, centre = link_group(_cells(table, "sh"), num, den)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, grp)), pa.array(np.full(n, block), pa.int32()), pa.array(ids), pa.array(ids[label]), pa.array(ids[centre])], names=["grp", "block", "doc_id", "label", "centre"])

    return run


def _ring(num: int, den: int, near_too: bool):
    """The documents that ask (home -1) against the star centres of other pieces: links, and documents in a centre's ring.

    A document is named with the centre's block and piece once, however many of the block's centres it is near to."""
    least = max(0, 2 * num - den) if near_too else num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _, _), table in _keyed(batches, ["grp", "part", "chunk"]):
            home = table.column("home").to_numpy()
            ids, pieces, sets = table.column("doc_id").to_numpy(), table.column("piece").to_numpy(), _cells(table, "sh")
            heads, docs = np.flatnonzero(home >= 0), np.flatnonzero(home < 0)
            index, of = Postings([sets[i] for i in heads]), pieces[heads]
            links, near = set(), set()
            for x in docs:
                for row, shared in index.search(sets[x], least, den, of != pieces[x]):
                    r = heads[row]
                    if den * shared >= num * (len(sets[x]) + len(sets[r]) - shared):
                        links.add((int(pieces[x]), int(pieces[r])))
                    else:
                        near.add((int(ids[x]), int(home[r]), int(pieces[x]), int(pieces[r])))
            out = [(True, grp, None, None, a, b) for a, b in links] + [(False, grp, *x) for x in near if (x[2], x[3]) not in links and (x[3], x[2]) not in links]
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["linked", "grp", "doc_id", "block", "pa", "pb"])

    return run


_RING = "linked boolean, grp long, doc_id long, block int, pa long, pb long"


def _search_blocks(num: int, den: int):
    """Links of a part of the queries to documents of other pieces in a block, as pairs of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _keyed(batches, ["grp", "block", "part"]):
            asks, pieces, sets = table.column("asks").to_numpy(zero_copy_only=False).astype(bool), table.column("piece").to_numpy(), _cells(table, "sh")
            held = np.flatnonzero(~asks)
            index, of = Postings([sets[i] for i in held]), pieces[held]
            links = {(int(pieces[x]), int(of[row])) for x in np.flatnonzero(asks) for row, _ in index.search(sets[x], num, den, of != pieces[x])}
            cols = list(zip(*links)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["src", "dst"])

    return run


def _on_tasks(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys and sorted by them. The number of tasks is given: their work is in the search, not in bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def _pieces(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with ``piece`` moved to the component that its node has in ``joined`` (node, component)."""
    moved = rows.join(joined.withColumnsRenamed({"node": "piece", "component": "_to"}), "piece", "left")
    return moved.withColumn("piece", F.coalesce("_to", "piece")).drop("_to")


def _between_blocks(spark, work: Workspace, sets: DataFrame, found: DataFrame, num: int, den: int, shingles: int, rows: int) -> DataFrame:
    """Edges between the labels (and pieces, which are labels) of the groups that have several blocks."""
    big = sets.filter(F.col("blocks") > 1).join(found.drop("block"), ["grp", "doc_id"]).withColumnsRenamed({"label": "piece"})
    big = work.table(big.withColumn("is_head", F.col("doc_id") == F.col("centre")).drop("centre"), "big")

    def to_chunks(heads: DataFrame, asking: DataFrame, parts: str) -> DataFrame:
        """Asking documents for every chunk of their group's centres, and the centres for each of its ``parts``."""
        chunks = _dealt(heads, ["grp"], "chunks", shingles, rows)
        cols = ["grp", "part", "chunk", "home", "doc_id", "piece", "sh"]
        asking = asking.join(chunks, F.col("grp") == F.col("_grp")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int"))
        asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("home", F.lit(-1))
        asked = heads.join(chunks, F.col("grp") == F.col("_grp")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
        asked = asked.withColumn("home", F.col("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
        return _on_tasks(asking.select(*cols).unionByName(asked.select(*cols)), "grp", "part", "chunk")

    heads = big.filter("is_head")
    first = to_chunks(heads, heads, "chunks").mapInArrow(_ring(num, den, False), _RING)
    first = work.table(first.select(F.col("pa").alias("src"), F.col("pb").alias("dst")).distinct(), "centre-links")
    big = work.table(_pieces(big, components(spark, first, work, "centres")), "pieces")

    apart = big.groupBy("grp").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a < b").select(F.col("grp").bitwiseXOR(F.lit(0).cast("bigint")).alias("_g"))
    left = work.table(big.join(apart, F.col("grp") == F.col("_g")).drop("_g"), "apart")
    seen = work.table(to_chunks(left.filter("is_head"), left, "blocks").mapInArrow(_ring(num, den, True), _RING), "rings")
    second = work.table(seen.filter("linked").select(F.col("pa").alias("src"), F.col("pb").alias("dst")).distinct(), "ring-links")
    joined = components(spark, second, work, "rings-joined")
    left = _pieces(left, joined)
    near = seen.filter("not linked").select("grp", "doc_id", "block", F.col("pa").alias("piece"), "pb").distinct()
    near = _pieces(near, joined).withColumnsRenamed({"piece": "pa", "pb": "piece"})
    near = _pieces(near, joined).filter(F.col("pa") != F.col("piece")).select("grp", "doc_id", "block").distinct()

    cols = ["grp", "block", "part", "asks", "piece", "sh"]
    asking = work.table(near.join(left.select("grp", "doc_id", "piece", "sh"), ["grp", "doc_id"]), "asking")
    parts = _dealt(asking, ["grp", "block"], "parts", shingles, rows)
    same = (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_block"))
    asking = asking.join(parts, same).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("asks", F.lit(True))
    asked = left.join(parts, same).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    third = _on_tasks(asking.select(*cols).unionByName(asked.select(*cols)), "grp", "block", "part").mapInArrow(_search_blocks(num, den), "src long, dst long")
    return first.unionByName(second).unionByName(third)


def join(
    spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", exact: bool = False, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``. ``exact`` proposes by prefixes in place of bands."""
    work = Workspace(spark, "ngrams")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    profile = work.table(narrow.mapInArrow(_profile(k, num, den, exact), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "profile")
    classes = work.table(profile.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")

    keys = profile.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).select("doc_id", F.explode("keys").alias("key"))
    proposed = work.table(_proposals(keys), "proposed")
    placed = proposed.select(F.col("src").alias("doc_id")).union(proposed.select("dst")).distinct()  # all that share a key
    sets = narrow.join(placed.hint("merge"), "doc_id").mapInArrow(_sets(k), "doc_id long, sh binary")
    sets = work.table(sets.groupBy("doc_id", F.md5("sh").alias("f")).agg(F.first("sh").alias("sh")).drop("f"), "raw-sets")  # repeated rows once
    if not exact:
        strict = work.table(sets.mapInArrow(_strict_keys(*banding(num, den, STRICT_ROWS)), "doc_id long, key long"), "strict-keys")
        proposed = _proposals(strict)
    groups = components(spark, proposed, work, "groups").withColumnsRenamed({"node": "doc_id", "component": "grp"})
    sets = work.table(_blocked(sets.join(groups, "doc_id").select("grp", "doc_id", "sh"), block_shingles, block_rows), "sets")
    for name in ("raw-sets", "strict-keys", "proposed"):
        work.drop(name)
    dealt = _on_tasks(sets, "grp", "block").select("grp", "block", "doc_id", "sh")
    found = work.table(dealt.mapInArrow(_link_blocks(num, den), "grp long, block int, doc_id long, label long, centre long"), "found")

    edges = found.filter(F.col("label") != F.col("doc_id")).select(F.col("doc_id").alias("src"), F.col("label").alias("dst"))
    if sets.filter("blocks > 1").limit(1).count():
        edges = edges.unionByName(_between_blocks(spark, work, sets, found, num, den, block_shingles, block_rows))
    labels = components(spark, edges, work, "links").withColumnsRenamed({"node": "rep"})
    named = classes.join(labels, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("c"))
    named = work.table(named, "named")
    for name in ("classes", "sets", "found", "big", "centre-links", "pieces", "apart", "rings", "ring-links", "asking"):
        work.drop(name)
    out = profile.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))
