"""Token counts under a unigram vocabulary: count-only Viterbi over Aho-Corasick matches.

The vocabulary and its scores come from a SentencePiece model file; nothing is trained. A text is prefixed with a blank,
blanks become U+2581, and a segment is a run of U+2581 with what follows it; no vocabulary piece crosses a segment's end
(checked on loading), so the best segmentation of a text is that of its segments. An Aho-Corasick automaton lists all
pieces ending at each place, longest first. The dynamic programme carries the best score and the piece count, and replaces
a path only by a strictly better one: at equal scores the piece that starts first wins, as in the tokenizer. A character
without a piece of its own may be unknown at the lowest score less 10, and then counts its UTF-8 bytes (byte fallback).

Null or empty text has 0 tokens. Texts are counted whole, however long, segment by segment. Repeated rows get equal counts, an
empty table gives an empty one, and extra columns pass through, but for ``n_tokens``, which is replaced. Counts of short
segments are kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

BLANK = "▁"
CACHE_SEGMENTS = 500_000
SEGMENT = regex.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Counter:
    """Automaton, scores and cache of one model file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece holds a blank after other characters; segments would not be independent")
        self.unknown = min(sp.get_score(i) for i in range(n)) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, s in self.pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """Pieces on the best path of one segment."""
        n = len(s)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done, pieces, unknown = 0, self.pieces, self.unknown

        def close(upto: int) -> None:  # places up to here have had all their matches
            nonlocal done
            while done < upto:
                c = s[done]
                done += 1
                if c not in pieces:
                    score = best[done - 1] + unknown
                    if not count[done] or score > best[done]:
                        best[done], count[done] = score, count[done - 1] + len(c.encode())

        for end, (length, score) in self.automaton.iter(s):
            end += 1
            if done < end - 1:
                close(end - 1)
            start = end - length
            score += best[start]
            if not count[end] or score > best[end]:
                best[end], count[end] = score, count[start] + 1
        close(n)
        return count[n]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total, cache = 0, self.cache
        for s in SEGMENT.findall(BLANK + text.replace(" ", BLANK)):
            c = cache.get(s)
            if c is None:
                c = self.segment(s)
                if len(s) <= 64:
                    if len(cache) >= CACHE_SEGMENTS:
                        cache.clear()
                    cache[s] = c
            total += c
        return total


_loaded: dict[str, Counter] = {}


def load(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def _count(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            rest = [i for i in range(batch.num_columns) if i != at]
            n = [counter.text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(n, pa.int64())], names=[batch.schema.names[i] for i in rest] + ["n_tokens"])

    return run


def count(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_tokens`` (a column of that name is replaced)."""
    docs = docs.select(*[c for c in docs.columns if c != "n_tokens"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col]
    return docs.mapInArrow(_count(path, text_col), ", ".join([*fields, "n_tokens long"]))
