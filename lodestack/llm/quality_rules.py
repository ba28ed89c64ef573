"""Quality rules: a threshold table compiled into one projection of built-in functions (no Python on executors).

Edge cases: a null or blank text has no words and fails the length rule; ratios with a zero denominator count as 0;
lines without a word are ignored; very long texts are measured whole, in memory linear in their length; rows are judged one by
one, so repeated rows and rows that share an id get a verdict each, and ties cannot occur (a value at a threshold passes); an
empty table gives an empty one; extra columns (also ones named like a metric) pass through unharmed in ``apply``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et la le les ou pas pour par que qui sur un une "
    "auf das dem den der die ein eine es für im ist mit nicht sich und von zu "
    "al como con del el las los más no para por se su una y"
).split()

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a lambda variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WORD_GAP, " "))


def _covered(words: Column, width: int) -> Column:
    """Words inside a ``width``-word window that occurs twice or more, by hashes sorted with their places."""

    def repeated(s: Column) -> Column:
        same = lambda x, at: F.get(s, at)["h"] == x["h"]
        places = F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["p"])
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            F.sort_array(places),
            start,
            lambda a, p: F.struct((p + width).alias("end"), (a["n"] + width - F.greatest(F.lit(0), a["end"] - p)).cast("bigint").alias("n")),
            lambda a: a["n"],
        )

    def over(hashes: Column) -> Column:
        whole = F.transform(hashes, lambda _, p: F.xxhash64(*[F.get(hashes, p + i) for i in range(width)]))
        windows = F.slice(whole, F.lit(1), F.size(hashes) - (width - 1))
        marked = lambda h: F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(marked(h), repeated)))

    return F.when(F.size(words) < width, F.lit(0).cast("bigint")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), over))


def metrics(text: Column) -> dict[str, Column]:
    """All counts of one text as long columns, each an expression over ``text`` and the array ``_words`` (see measure)."""
    raw = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": F.length(raw) - F.length(F.translate(raw, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_open_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }


@dataclass(frozen=True)
class Rule:
    """A row passes when low <= numerator / denominator <= high; a zero denominator makes the ratio 0."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def passes(self, of: dict[str, Column]) -> Column:
        bottom = of[self.denominator] if self.denominator else F.lit(1)
        ratio = F.when(bottom == 0, F.lit(0.0)).otherwise(of[self.numerator] / bottom)
        tests = [ratio >= self.low] if self.low is not None else []
        tests += [ratio <= self.high] if self.high is not None else []
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]


DEFAULT_RULES = (
    Rule("length", "n_words", "", low=20),
    Rule("word_length", "word_chars", "n_words", low=2, high=12),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03),
    Rule("stutter", "n_stutters", "n_words", high=0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("open_lines", "n_open_lines", "n_lines", high=0.3),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.3),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_stutters", "n_lines", "n_open_lines")


def verdict(counts: dict[str, Column], rules=DEFAULT_RULES) -> Column:
    """Compile the table into one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        out = out & rule.passes(counts)
    return out


def counts_struct(text: Column) -> Column:
    """All counts of a text as one struct, computed in a single expression tree."""
    spaced = _spaced(F.coalesce(text, F.lit("")))

    def of(s: Column) -> Column:
        words = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))

        def counted(w: Column) -> Column:
            n = F.size(w)
            fields = {
                "n_words": n,
                "word_chars": F.length(s) - F.greatest(n - 1, F.lit(0)),
                "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))),
                "n_stutters": F.size(F.filter(w, lambda x, k: F.coalesce(F.get(w, k - 1) == x, F.lit(False)))),
                "n_repeat_words": _covered(w, WINDOW),
            } | metrics(text)
            return F.struct(*[fields[k].cast("bigint").alias(k) for k in COUNTS])

        return let(words, counted)

    return let(spaced, of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=DEFAULT_RULES) -> DataFrame:
    """(id, counts, base_failed, kept) of every row; one narrow projection, no shuffle."""
    c = docs.select(F.col(id_col).alias(id_col), counts_struct(F.col(text_col)).alias("_c"))
    of = {k: F.col(f"_c.{k}") for k in COUNTS}
    failed = (of["n_words"] < 20) | (100 * of["n_repeat_words"] > 30 * of["n_words"])
    return c.select(id_col, *[of[k].alias(k) for k in COUNTS], failed.alias("base_failed"), (~failed & verdict(of, rules)).alias("kept"))


def apply(docs: DataFrame, text_col: str = "text", rules=DEFAULT_RULES) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    c = counts_struct(F.col(text_col))
    keep = let(c, lambda x: verdict({k: x[k] for k in COUNTS}, rules) & ~(100 * x["n_repeat_words"] > 30 * x["n_words"]))
    return docs.filter(keep)
