"""File languages, declaration patterns, and what a declaration line tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of each language.
EXTENSIONS = {
    "go": "go",
    "python": "py pyw pyi",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts tsx",
    "java": "java",
    "kotlin": "kt kts",
    "swift": "swift",
    "rust": "rs",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hxx",
    "csharp": "cs",
    "scala": "scala sc",
    "ruby": "rb rake",
    "php": "php",
    "shell": "sh bash zsh fish",
    "markdown": "md mdx rst txt",
    "config": "json yaml yml toml ini env",
    "sql": "sql",
    "lua": "lua",
    "dart": "dart",
    "haskell": "hs lhs",
    "elixir": "ex exs",
    "clojure": "clj cljs cljc",
    "web": "html htm css scss sass less svelte vue",
}
LINE_WINDOW_LANGUAGES = ("markdown", "config", "sql", "web")

# Patterns of lines that start a declaration, by language.
DECLARATIONS = {
    "python": [r"^(async\s+def\s+\w+|def\s+\w+|class\s+\w+)"],
    "javascript": [
        r"^(export\s+)?(async\s+)?function\s+\w+",
        r"^(export\s+)?(default\s+)?class\s+\w+",
        r"^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(",
        r"^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?function",
    ],
    "typescript": [
        r"^(export\s+)?(async\s+)?function\s+\w+",
        r"^(export\s+)?(abstract\s+)?class\s+\w+",
        r"^(export\s+)?interface\s+\w+",
        r"^(export\s+)?type\s+\w+\s*=",
        r"^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(",
    ],
    "java": [
        r"^\s*(public|private|protected|static|final|abstract|synchronized)[\w\s<>\[\]]*\s+\w+\s*\(",
        r"^\s*(public|private|protected)?\s*(abstract\s+)?class\s+\w+",
        r"^\s*(public\s+)?interface\s+\w+",
        r"^\s*(public\s+)?enum\s+\w+",
    ],
    "kotlin": [
        r"^\s*(suspend\s+)?fun\s+\w+",
        r"^\s*(data\s+|sealed\s+|abstract\s+|open\s+)?class\s+\w+",
        r"^\s*object\s+\w+",
        r"^\s*interface\s+\w+",
    ],
    "swift": [
        r"^\s*(public|private|internal|open|fileprivate)?\s*(static\s+|class\s+)?(func)\s+\w+",
        r"^\s*(public|private|internal|open)?\s*(final\s+)?class\s+\w+",
        r"^\s*struct\s+\w+",
        r"^\s*protocol\s+\w+",
        r"^\s*enum\s+\w+",
    ],
    "rust": [
        r"^\s*(pub(\([\w:]+\))?\s+)?(async\s+)?fn\s+\w+",
        r"^\s*(pub(\([\w:]+\))?\s+)?struct\s+\w+",
        r"^\s*(pub(\([\w:]+\))?\s+)?enum\s+\w+",
        r"^\s*(pub(\([\w:]+\))?\s+)?trait\s+\w+",
        r"^\s*impl(\s*<[^>]*>)?\s+\w+",
    ],
    "cpp": [
        r"^[\w:*&<>\s]+\s+\w+\s*\([^;]*\)\s*(\{|$)",
        r"^\s*(class|struct)\s+\w+",
        r"^\s*namespace\s+\w+",
    ],
    "c": [
        r"^[\w*\s]+\s+\w+\s*\([^;]*\)\s*\{",
        r"^\s*(struct|enum|union)\s+\w+",
    ],
    "csharp": [
        r"^\s*(public|private|protected|internal|static|virtual|override|abstract|async)[\w\s<>\[\]]*\s+\w+\s*\(",
        r"^\s*(public|private|protected|internal)?\s*(abstract\s+|sealed\s+)?class\s+\w+",
        r"^\s*(public\s+)?interface\s+\w+",
        r"^\s*(public\s+)?enum\s+\w+",
        r"^\s*namespace\s+[\w.]+",
    ],
    "scala": [
        r"^\s*(def)\s+\w+",
        r"^\s*(case\s+|abstract\s+|sealed\s+)?class\s+\w+",
        r"^\s*object\s+\w+",
        r"^\s*trait\s+\w+",
    ],
    "ruby": [r"^\s*def\s+\w+", r"^\s*class\s+\w+", r"^\s*module\s+\w+"],
    "php": [
        r"^\s*(public|private|protected|static)?\s*function\s+\w+",
        r"^\s*(abstract\s+|final\s+)?class\s+\w+",
        r"^\s*interface\s+\w+",
        r"^\s*trait\s+\w+",
    ],
    "shell": [r"^\s*\w[\w-]*\s*\(\s*\)\s*\{", r"^\s*function\s+\w+"],
    "lua": [
        r"^\s*(local\s+)?function\s+\w+",
        r"^\s*(local\s+)?\w+\s*=\s*function",
        r"^\s*function\s+\w+\.\w+",
    ],
    "dart": [
        r"^\s*(async\s+)?[\w<>]*\s+\w+\s*\([^)]*\)\s*(\{|=>)",
        r"^\s*(abstract\s+|final\s+)?class\s+\w+",
        r"^\s*enum\s+\w+",
        r"^\s*mixin\s+\w+",
        r"^\s*extension\s+\w+",
    ],
    "haskell": [
        r"^\s*\w[\w']*\s*::",
        r"^\s*(data|newtype|type)\s+\w+",
        r"^\s*class\s+\w+",
        r"^\s*instance\s+[\w.]+",
    ],
    "elixir": [r"^\s*def\s+\w+", r"^\s*defp\s+\w+", r"^\s*defmodule\s+\w+", r"^\s*defprotocol\s+\w+", r"^\s*defimpl\s+\w+"],
    "clojure": [
        r"^\s*\(defn\s+\w+",
        r"^\s*\(defn-\s+\w+",
        r"^\s*\(def\s+\w+",
        r"^\s*\(defmacro\s+\w+",
        r"^\s*\(defprotocol\s+\w+",
        r"^\s*\(defrecord\s+\w+",
        r"^\s*\(defmulti\s+\w+",
    ],
}

# Words stripped, in this order, from the front of a declaration to reach its name.
NAME_PREFIXES = [
    "export default ", "export ", "public ", "private ", "protected ", "static ", "async ", "abstract ", "final ", "sealed ", "open ",
    "suspend ", "override ", "virtual ", "pub ", "async fn ", "fn ", "def ", "class ", "function ", "func ", "fun ", "struct ",
    "interface ", "trait ", "enum ", "impl ", "object ", "module ", "namespace ", "type ",
]
# Words whose presence makes a declaration a class.
CLASS_WORDS = ["class ", "interface ", "trait ", "protocol ", "struct ", "enum ", "impl "]

_BY_EXTENSION = {f".{e}": lang for lang, exts in EXTENSIONS.items() for e in exts.split()}


def language_of_path(path: str) -> str:
    """Language of one path (driver side)."""
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return _BY_EXTENSION.get(name[dot:].lower(), "unknown") if dot >= 0 else "unknown"


def language(path: Column) -> Column:
    """Language by lower-cased extension, or ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in _BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))), F.lit("unknown"))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def starts_declaration(lang: Column, line: Column) -> Column:
    """Whether a line matches a declaration pattern of its language (false where the language has none)."""
    out = None
    for name, patterns in DECLARATIONS.items():
        hit = line.rlike("(?md)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(lang == name, hit) if out is None else out.when(lang == name, hit)
    return out.otherwise(F.lit(False))


def has_patterns(lang: Column) -> Column:
    return lang.isin(list(DECLARATIONS))


def declaration_type(line: Column) -> Column:
    lower = F.lower(trimmed(line))
    return F.when(lower.rlike("|".join(CLASS_WORDS)), "class").otherwise("function")


def declaration_name(line: Column) -> Column:
    """Name on a declaration line: strip leading keywords in one pass, then read up to a delimiter, at most 64 bytes."""
    strip = lambda acc, kw: F.when(F.startswith(F.lower(acc), kw), F.substring(acc, F.length(kw) + 1, F.length(acc))).otherwise(acc)
    rest = F.aggregate(F.array(*[F.lit(k) for k in NAME_PREFIXES]), trimmed(line), strip)
    name = F.transform(F.array(rest), lambda r: F.when(r.rlike(r"^[^ \t(<{:\[=]+[ \t(<{:\[=]"), F.regexp_extract(r, r"^[^ \t(<{:\[=]+", 0)).otherwise(F.make_valid_utf8(F.substring(F.encode(r, "UTF-8"), 1, 64).cast("string"))))
    return F.element_at(name, 1)
