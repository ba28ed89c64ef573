"""Tokens and byte-wise text functions, all as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the query and index tokenizer.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this have "
    "i you we they what where when why how which who can could would should do does did don't doesn't didn't"
).split()

BREAK = r"[\p{P}\p{IsWhite_Space}]+"
CAMEL = "([a-z0-9])([A-Z])"
EMBED_CHARS = 384
PREVIEW_BYTES = 200


def words(text: Column) -> Column:
    """Runs between white space and punctuation (category P, so also underscores); symbols such as + = $ < stay."""
    return F.array_remove(F.split(text, BREAK), "")


def tokens(text: Column) -> Column:
    """Index and query tokens: lower case first, so camel case is not split."""
    return words(F.lower(F.trim(text)))


def once(value: Column) -> Column:
    """The same value in a row of its own generator: filters and projections above read it instead of working it out again."""
    return F.explode(F.array(value))


def first_tokens(text: Column, n: int) -> Column:
    """The first n tokens; the rest of the text is not split."""
    parts = F.split(F.lower(F.trim(text)), BREAK, n + 2)  # an empty part before a leading break, n tokens and the rest
    return F.slice(F.array_remove(F.slice(parts, 1, n + 1), ""), 1, n)


def camel_tokens(text: Column) -> Column:
    """Tokens with camel case split, each lower-cased."""
    parts = F.transform(words(text), lambda w: F.split(F.lower(F.regexp_replace(w, CAMEL, "$1 $2")), " "))
    return F.filter(F.flatten(parts), lambda x: x != "")


def without_stop_words(toks: Column) -> Column:
    """Tokens of two bytes or more that are no stop words."""
    return F.filter(toks, lambda t: ~t.isin(STOP_WORDS) & (F.octet_length(t) > 1))


def query_tokens(text: Column) -> Column:
    return without_stop_words(tokens(text))


def valid_utf8(raw: Column) -> Column:
    """Bytes as a string; a run of invalid bytes becomes one replacement character."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+", "�")


def embedding_text(content: Column) -> Column:
    """What an embedder sees: at most 384 characters."""
    return F.substring(F.make_valid_utf8(content), 1, EMBED_CHARS)


def preview(content: Column) -> Column:
    """The first 200 bytes; a cut character becomes a replacement character."""
    return valid_utf8(F.substring(F.encode(content, "UTF-8"), 1, PREVIEW_BYTES))


def comma_list(value: Column) -> Column:
    """Trimmed, non-empty entries of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    """First 16 bytes of the SHA-256 of ``path:start:end:content``, in hex."""
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content), 256), 1, 32)


def parser_id(path: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, line.cast("string")), 256), 1, 16)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
