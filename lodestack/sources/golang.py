"""Top-level declarations of Go source by a token scanner.

The scanner knows comments, strings, runes, raw strings and brackets; it inserts statement ends at newlines as the language
defines and finds functions, methods, types, imports, constants and variables. Unbalanced brackets, unfinished literals or a
missing package clause fail the file.
"""

from __future__ import annotations

import re

# Keywords of Go, and tokens after which a newline ends a statement.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS = set("break continue fallthrough return ++ -- ) ] }".split())
TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<str>\"(?:\\.|[^\"\\\n])*\")|(?P<rune>'(?:\\.[^'\n]*|[^'\\\n])')"
    r"|(?P<num>\.?[0-9](?:[0-9a-zA-Z_.]|(?<=[eEpP])[+-])*)|(?P<id>[^\W\d]\w*)|(?P<op>\+\+|--|&&|\|\||<-|:=|\.\.\.|<<=?|>>=?|&\^=?|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>()\[\]{},;.:~])",
    re.S,
)
PAIRS = {")": "(", "]": "[", "}": "{"}


class GoSyntaxError(ValueError):
    pass


def tokenize(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of all tokens; statement ends are ``;`` tokens."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1

    def end_statement() -> None:
        if out and (out[-1][0] in ("id", "num", "str", "raw", "rune") and out[-1][1] not in KEYWORDS or out[-1][1] in ENDS):
            out.append(("end", ";", line))

    while at < len(source):
        m = TOKEN.match(source, at)
        if m is None:
            raise GoSyntaxError(f"unexpected {source[at]!r} on line {line}")
        kind, text = m.lastgroup, m[0]
        if kind == "nl" or kind == "block" and "\n" in text:
            end_statement()
        elif kind not in ("space", "line", "block"):
            out.append((kind, text, line))
        line += text.count("\n")
        at = m.end()
    end_statement()
    return out


def _matching(tokens) -> dict[int, int]:
    """Closing place of each opening bracket."""
    stack, pairs = [], {}
    for i, (kind, text, line) in enumerate(tokens):
        if kind == "op" and text in "([{":
            stack.append(i)
        elif kind == "op" and text in PAIRS:
            if not stack or tokens[stack[-1]][1] != PAIRS[text]:
                raise GoSyntaxError(f"unbalanced {text!r} on line {line}")
            pairs[stack.pop()] = i
    if stack:
        raise GoSyntaxError(f"unclosed bracket on line {tokens[stack[-1]][2]}")
    return pairs


def _calls(tokens, pairs, start: int, end: int) -> list[str]:
    """Sorted distinct callees in a body: ``f(`` and ``x.f(``; longer selectors are left out."""
    found = set()
    i = start
    while i < end:
        kind, text, _ = tokens[i]
        if kind == "id" and text == "func":  # a literal's signature holds no calls; its body does
            i += 1
            while i < end and tokens[i][1] == "(":
                i = pairs[i] + 1
            continue
        if kind == "id" and (text not in KEYWORDS) and i + 1 < end:
            after = i + 1
            if tokens[after][1] == "(" and tokens[after][0] == "op":
                before = tokens[i - 1][1] if i > start else ""
                if before == ".":
                    owner, deeper = tokens[i - 2], tokens[i - 3][1] if i - 3 >= start else ""
                    if owner[0] == "id" and owner[1] not in KEYWORDS and deeper != ".":
                        found.add(f"{owner[1]}.{text}")
                else:
                    found.add(text)
        i += 1
    return sorted(found)


def _receiver(tokens, start: int, end: int) -> str | None:
    """Type name of a method's receiver: ``T`` or ``*T`` (generic receivers have none)."""
    inner = [t for t in tokens[start:end] if t[1] not in (";", ",")]
    names = [t[1] for t in inner]
    if names and names[-1] == "]":
        return None
    if len(names) >= 2 and names[-2] == "*" and inner[-1][0] == "id":
        return names[-1]
    plain = len(names) in (1, 2) and all(t[0] == "id" for t in inner)
    return names[-1] if plain else None


def _names(tokens, pairs, start: int, end: int) -> list[str]:
    """First identifier of each spec between two places."""
    out, fresh, i = [], True, start
    while i < end:
        kind, text, _ = tokens[i]
        if text == ";":
            fresh = True
        elif fresh:
            if kind == "id":
                out.append(text)
            fresh = False
        i = pairs[i] + 1 if i in pairs and kind == "op" and text in "([{" else i + 1
    return out


def declarations(source: str) -> list[dict]:
    """Chunks of a file: type, start and end line, content and metadata, one per top-level declaration."""
    tokens = tokenize(source)
    pairs = _matching(tokens)
    if not tokens or tokens[0][1] != "package":
        raise GoSyntaxError("expected a package clause")
    lines = source.split("\n")
    out: list[dict] = []
    i = 0
    while i < len(tokens):
        text, start_line = tokens[i][1], tokens[i][2]
        end = i  # place after the declaration's last token
        while end < len(tokens) and tokens[end][1] != ";":
            end = pairs[end] + 1 if end in pairs else end + 1
        last_line = tokens[end - 1][2] + (tokens[end - 1][1].count("\n") if end > i else 0)
        meta: dict[str, str] = {}
        kind = None
        if text == "func":
            kind, k = "function", i + 1
            if k < end and tokens[k][1] == "(":
                kind = "method"
                receiver = _receiver(tokens, k + 1, pairs[k])
                if receiver:
                    meta["receiver"] = receiver
                k = pairs[k] + 1
            if k >= end or tokens[k][0] != "id":
                raise GoSyntaxError(f"expected a name on line {start_line}")
            meta["name"] = tokens[k][1]
            if tokens[end - 1][1] == "}":
                body = next(o for o, c in pairs.items() if c == end - 1)
                calls = _calls(tokens, pairs, body + 1, end - 1)
                if calls:
                    meta["calls"] = ",".join(calls)
        elif text in ("type", "import", "const", "var"):
            group = i + 1 < end and tokens[i + 1][1] == "("
            a, b = (i + 2, pairs[i + 1]) if group else (i + 1, end)
            if text == "type":
                kind, names = "class", _names(tokens, pairs, a, b)
                if names:
                    meta = {"types": ",".join(names), "name": names[0]}
            elif text == "import":
                kind, paths = "import", [t[1].strip('"') for t in tokens[a:b] if t[0] in ("str", "raw")]
                if paths:
                    meta["imports"] = ",".join(paths)
            else:
                kind = "other"
        elif text not in ("package", ";"):
            raise GoSyntaxError(f"unexpected {text!r} on line {start_line}")
        if kind:
            out.append({"chunk_type": kind, "start_line": start_line, "end_line": last_line, "content": "\n".join(lines[start_line - 1 : last_line]), "metadata": meta})
        i = end + 1
    return out
