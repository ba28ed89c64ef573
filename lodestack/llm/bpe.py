"""Byte-level BPE over length-bucketed padded matrices.

Texts are cut by the public pre-split pattern; each distinct piece is encoded once per process. Pieces of similar length
form a padded (pieces x bytes) id matrix, whatever their length. In every round each row merges its leftmost pair of minimum
rank; ranks of new pairs come from an open-addressing hash table. Further pairs of that rank in the row are the next rounds'
leftmost minimum as long as no merge makes a pair of lower rank, so they are merged in the same round, and the first merge
that makes one ends the row's round. This is the library's own order of merges (lowest rank first, leftmost on ties).
Merged places are unlinked rather than shifted, the minimum of a row is read from the minima of its blocks of ``BLOCK``
places, and rows and places are compacted once enough are dead, so a round costs little more than its merges and a piece
about as much as its length. A byte sequence that is a whole vocabulary entry is one token even where no merge chain builds it.

Null text counts as empty: no tokens, digests of nothing. A text is never cut other than by the pattern, and very long pieces
take the same path in memory linear in their length. Equal rows give equal results, ties are decided as the library does, and
an empty table gives an empty one. The cache of pieces is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_PIECES = 400_000
CELLS = 1 << 18
BLOCK = 64


class BytePairs:
    """Rank table, pair lookup and decoder of one vocabulary file (token in base64, blank, rank)."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._pairs()
        self.cache: dict[str, bytes] = {}

    def _pairs(self) -> None:
        """Every split of a token into two tokens, keyed by the pair's ids, in an open-addressing table."""
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] < 0
            slots, firsts = np.unique(at[free], return_index=True)
            put = left[free][firsts]
            self.slot_key[slots], self.slot_rank[slots] = keys[put], values[put]
            done = np.isin(left, put)
            left, at = left[~done], (at[~done] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none."""
        keys = (left << 20) | right
        out = np.full(keys.shape, NONE, np.int64)
        flat, found = keys.ravel(), out.ravel()
        todo, at = np.arange(flat.size), self._home(flat)
        while len(todo):
            held = self.slot_key[at]
            hit = held == flat[todo]
            found[todo[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return found.reshape(keys.shape)

    def _layout(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Flat (ids, ranks, next, previous, block minima) of a padded matrix without gaps, and its width in blocks and block."""
        n, wide = ids.shape
        block = wide if wide <= BLOCK else BLOCK
        blocks = -(-wide // block)
        full = np.zeros((n, blocks * block), np.int64)
        full[:, :wide] = ids
        width = blocks * block
        ranks = np.full((n, width), NONE, np.int64)
        at = np.arange(wide - 1)[None, :] + 1 < lengths[:, None]
        ranks[:, : wide - 1][at] = self.pair_ranks(ids[:, :-1][at], ids[:, 1:][at])
        place = np.broadcast_to(np.arange(width, dtype=np.int64), (n, width))
        after = np.where(place + 1 < lengths[:, None], place + 1, -1)
        return full.ravel(), ranks.ravel(), after.ravel(), (place - 1).ravel(), ranks.reshape(n * blocks, block).min(axis=1), blocks, block

    def _merge(self, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a padded matrix."""
        done: list = [None] * len(rows)
        index = np.arange(len(rows))
        lengths = lengths.copy()
        ids, ranks, after, before, least, blocks, block = self._layout(rows, lengths)
        while True:
            n, width = len(index), blocks * block
            by_row = least.reshape(n, blocks)
            best = by_row.min(axis=1)
            going = best != NONE
            some = int(going.sum())
            if some < n * 3 // 4 or not some or (blocks > 1 and 2 * int(lengths.max()) < width):
                live = (after >= 0).reshape(n, width)  # the last place of a row has no next one
                live[np.arange(n), self._last(before, after, lengths, n, width)] = True
                tokens = ids.reshape(n, width)
                for k in np.flatnonzero(~going):
                    done[index[k]] = tokens[k][live[k]]
                if not some:
                    return done
                index, lengths, live, tokens = index[going], lengths[going], live[going], tokens[going]
                packed = np.zeros((some, int(lengths.max())), np.int64)
                packed[np.arange(packed.shape[1])[None, :] < lengths[:, None]] = tokens[live]
                ids, ranks, after, before, least, blocks, block = self._layout(packed, lengths)
                continue
            # all places of minimum rank, by row and place
            at = np.flatnonzero((by_row == best[:, None]).ravel() & np.repeat(going, blocks)) if some < n or blocks > 1 else np.arange(n)
            cells = ranks.reshape(n * blocks, block)[at]
            k, offset = np.nonzero(cells == best[at // blocks][:, None])
            p = at[k] * block + offset
            row = p // width
            base = row * width
            q = base + after[p]
            # of pairs that overlap, every second one from the left
            follows = np.zeros(len(p), bool)
            follows[1:] = (q[:-1] == p[1:]) & (row[1:] == row[:-1])
            if follows.any():
                place = np.arange(len(p))
                start = np.maximum.accumulate(np.where(follows, 0, place))
                take = (place - start) % 2 == 0
                p, q, row, base = p[take], q[take], row[take], base[take]
            token = best[row]
            right, left = after[q], before[p]
            has_right, has_left = right >= 0, left >= 0
            right, left = base + right, base + left
            joins = np.zeros(len(p), bool)  # the place to the left has just been merged in this round
            joins[1:] = (q[:-1] == left[1:]) & (row[1:] == row[:-1])
            left = np.where(joins, np.roll(p, 1), left)
            right_rank, left_rank = np.full(len(p), NONE, np.int64), np.full(len(p), NONE, np.int64)
            right_rank[has_right] = self.pair_ranks(token[has_right], ids[right[has_right]])
            left_rank[has_left] = self.pair_ranks(np.where(joins, token, ids[left])[has_left], token[has_left])
            lower = (right_rank < token) | (left_rank < token)
            if lower.any():  # the row goes on with the pair of lower rank
                place = np.arange(len(p))
                first = np.full(n, len(p))
                np.minimum.at(first, row[lower], place[lower])
                on = place <= first[row]
                p, q, row, token, right, left, has_right, has_left, right_rank, left_rank = (x[on] for x in (p, q, row, token, right, left, has_right, has_left, right_rank, left_rank))
                base = base[on]
            ids[p] = token
            after[p] = np.where(has_right, right - base, -1)
            before[right[has_right]] = (p - base)[has_right]
            after[q], ranks[q] = -1, NONE
            ranks[p] = right_rank
            ranks[left[has_left]] = left_rank[has_left]
            lengths -= np.bincount(row, minlength=n)
            if blocks == 1:
                least = ranks.reshape(n, block).min(axis=1)
            else:
                touched = np.concatenate([p, q, left[has_left]]) // block
                least[touched] = ranks.reshape(-1, block)[touched].min(axis=1)

    @staticmethod
    def _last(before: np.ndarray, after: np.ndarray, lengths: np.ndarray, n: int, width: int) -> np.ndarray:
        """The last live place of each row."""
        open_ = (after >= 0).reshape(n, width)
        some = open_.any(axis=1)
        at = width - 1 - open_[:, ::-1].argmax(axis=1)
        return np.where(some, after.reshape(n, width)[np.arange(n), at], 0)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pieces]
        out: list = [None] * len(raw)
        whole = self.ranks
        hard = []
        for k, b in enumerate(raw):
            r = whole.get(b)
            if r is not None:
                out[k] = r.to_bytes(4, "little")
            else:
                hard.append(k)
        hard.sort(key=lambda k: len(raw[k]))
        i = 0
        while i < len(hard):  # a bucket: pieces of one length class, as many as fit the cells
            shortest = len(raw[hard[i]])
            width = max(shortest + 3, shortest * 5 // 4)
            j = i
            while j < len(hard) and len(raw[hard[j]]) <= width and (j - i) * width < CELLS:
                j += 1
            mine = hard[i:j]
            lengths = np.array([len(raw[k]) for k in mine])
            wide = int(lengths.max())
            cells = np.frombuffer(b"".join(raw[k].ljust(wide, b"\0") for k in mine), np.uint8).reshape(len(mine), wide)
            for k, ids in zip(mine, self._merge(self.byte_ids[cells], lengths)):
                out[k] = ids.astype("<u4").tobytes()
            i = j
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t) for t in texts]
        cache = self.cache
        new = {p for c in cut for p in c if p not in cache}
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = {p for c in cut for p in c}
        fresh = sorted(new)
        cache.update(zip(fresh, self.encode_pieces(fresh)))
        return [b"".join(map(cache.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


NONE = np.iinfo(np.int64).max
_loaded: dict = {}


def load(path: str, pattern: str) -> BytePairs:
    """One vocabulary per process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs(path, pattern)
    return _loaded[path, pattern]


def _rows(path: str, pattern: str, text_col: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            rest = [i for i in range(batch.num_columns) if i != at]
            i = 0
            while i < batch.num_rows:  # a bounded amount of text at a time
                texts, size, j = [], 0, i
                while j < batch.num_rows and (not texts or size < 4_000_000):
                    texts.append(batch.column(at)[j].as_py() or "")
                    size += len(texts[-1])
                    j += 1
                ids = bpe.encode_batch(texts)
                cols = [batch.column(k).slice(i, j - i) for k in rest]
                new = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ]
                names = [batch.schema.names[k] for k in rest] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    new.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols + new, names=names)
                i = j

    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """All other columns of ``docs`` with ``n_tokens``, digests of ids and decoded bytes, and the ids themselves.

    Columns of ``docs`` with those names are replaced.
    """
    made = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    docs = docs.select(*[c for c in docs.columns if c == text_col or c not in made])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*fields, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids)
    return docs.mapInArrow(_rows(path, pattern, text_col, with_ids), schema)
