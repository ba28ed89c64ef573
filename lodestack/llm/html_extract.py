"""HTML extraction by tag-path ratios.

One pass of a tokenizer turns a page into blocks (runs of text between block-level tags), each in an element of the page's
tree. Text of menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments is known by
element, role or class and never becomes a block. Class and id don't count for an element that holds most of the page's
unlinked text (if it is named for text by others, such as comments, or as a footer or menu, only where no other text is left) or the only h1, nor
where nothing else is left; an article element is judged by undivided names only.

A tag path goes from the root to the block's element; containers without text of their own go by element and class, so that
the paragraphs of two columns have different paths. For every path the text length and the punctuation of all its blocks are
aggregated; the ratios per block are smoothed over neighbouring blocks, fused by their geometric mean, and paths above a
threshold are content. The deepest element that holds all content blocks and their headings (the article) then gives the
text: of a page's article or main element (also by role) all blocks, so short paragraphs and headings before, between and after long ones
stay; where no such element marks the article, those from its first to its last block whose path passes the threshold without
its neighbours' help, and at both ends only what shares a container with such a block, or a heading in front. Content outside
all article and main elements counts only where those don't hold nine tenths of it.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined by newlines
in page order. Null or empty html, or a page without content, gives an empty text. Unclosed and stray tags are tolerated; a
``<`` that starts no complete tag is text. Pages are handled whole, one at a time, in time linear in their length and tags,
however deep. Repeated rows give repeated rows, ties don't occur, an empty table gives an empty one, and extra columns pass
through, but for ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
SKIP = RAW | set("nav footer aside button select option menu dialog object applet svg math canvas audio video head datalist".split())
FORMS = {"form", "fieldset"}  # known by name like a class: some pages are one form
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("article main body html".split())
MARKED = {"article", "main"}
HOLDERS = set("article main section div body html center".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NEVER = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle taboola outbrain sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations comment comments commentlist disqus reply "
    "replies respond login signin signup register search toolbar pagination pager copyright legal disclaimer alert banner "
    "widget sitemap skip form hidden".split()
)
# Of these, words for text by others that can be longer than the article; the rest name parts of a layout, or topics.
OTHERS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle taboola outbrain sponsor sponsored promo promotion cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription related recommended recommendations comment comments commentlist disqus reply replies "
    "respond disclaimer copyright".split()
)
# Parts of a page's frame, when one of these is the whole name: never the article where there is other text.
FRAME = set("footer nav navbar navigation breadcrumb breadcrumbs pagination pager sitemap".split())
AROUND = set("has with no without".split())
TOPICS = set("category tag topic".split())  # category-legal, tag-search: what an article is about
# End tags that a start tag implies: the start tag, and the open elements it closes up to the scope.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"}}

PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^<>\"']*)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[\"'>]")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PIECES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？¿¡]")


@dataclass(slots=True, eq=False)
class Element:
    """A block-level element: the blocks in it are those from ``start`` up to ``stop``."""

    name: str
    parent: Element | None
    label: str  # with class and id
    start: int
    stop: int = 0
    own: int = 0  # blocks directly in it
    path: int = 0
    holder: Element | None = None  # the nearest container, this one included

    def __post_init__(self):
        self.holder = self if self.name in HOLDERS else self.parent and self.parent.holder

    def up(self, names: set[str]) -> Element | None:
        """The nearest element of one of the names, this one included."""
        e = self
        while e is not None and e.name not in names:
            e = e.parent
        return e


@dataclass(slots=True, eq=False)
class Block:
    text: str
    node: Element | None
    linked: int  # characters inside links
    heading: bool
    marked: bool  # inside an article or main element

    @property
    def path(self) -> int:
        return self.node.path if self.node else 0


class Markup:
    """Tags of a page in order, in one pass."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.gone: set[str] = set()  # quotes that don't occur any more

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(end, "/" of an end tag, name, attributes) of the tag that starts at ``at``; other markup has no name."""
        page = self.page
        if m := PLAIN_TAG.match(page, at):
            return m.end(), m[1], m[2].lower(), m[3]
        if page.startswith("<!--", at):
            m = COMMENT_END.search(page, at + 4)
            return (m.end() if m else len(page)), "", "", ""
        if at > self.last:
            return None
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            return None if end < 0 else (end + 3, "", "", page[at + 9 : end])
        if page[at + 1 : at + 2] in ("!", "?") or page[at + 1 : at + 2] == "/" and not TAG_NAME.match(page, at):
            return page.find(">", at) + 1, "", "", ""
        m = TAG_NAME.match(page, at)
        if not m:
            return None
        place = m.end()
        while stop := STOP.search(page, place):
            place, found = stop.end(), stop[0]
            if found == ">":
                return place, m[1], m[2].lower(), page[m.end() : place - 1]
            before = place - 2
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and found not in self.gone:  # a value in quotes
                end = page.find(found, place)
                if end < 0:
                    self.gone.add(found)
                else:
                    place = end + 1
        return None


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def _hidden(a: dict[str, str]) -> bool:
    """Whether role or visibility mark an element as something other than the article."""
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return a.get("role", "").lower() in ROLES


def _named(a: dict[str, str], whole: bool) -> set[str]:
    """Words of class and id that mark an element as something other than the article; with ``whole`` only undivided names."""
    out = set()
    for name in (*a.get("class", "").split(), a.get("id", "")):
        parts = [p.lower() for p in PIECES.findall(name)]
        if parts and parts[0] not in TOPICS and not (whole and len(parts) > 1):
            out |= {p for k, p in enumerate(parts) if p in NEVER and not (k and parts[k - 1] in AROUND)}
    return out


@dataclass
class Named:
    """What the elements marked by class or id hold, by element number, in characters that are not in links."""

    words: dict[int, set[str]] = field(default_factory=dict)
    around: dict[int, int] = field(default_factory=dict)  # the marked element around each, 0 for none
    others: dict[int, bool] = field(default_factory=dict)  # whether it or one around it is apart
    apart: set[int] = field(default_factory=set)  # named for text by others or for the page's frame
    chars: dict[int, int] = field(default_factory=dict)
    titled: set[int] = field(default_factory=set)  # with an h1 inside
    total: int = 0
    plain: int = 0  # text besides headings that is in no element apart
    title: bool = False  # an h1 outside all of them

    def add(self, number: int, words: set[str], around: int, frame: bool) -> None:
        self.words[number], self.around[number], self.chars[number] = words, around, 0
        if frame or words & OTHERS:
            self.apart.add(number)
        self.others[number] = number in self.apart or self.others.get(around, False)

    def wrappers(self) -> set[int]:
        """Those that hold most of the page's text or its only h1, and so the article."""
        chars, titled = dict(self.chars), set(self.titled)
        for i in sorted(chars, reverse=True):  # inner ones first
            if self.around[i]:
                chars[self.around[i]] += chars[i]
                if i in titled:
                    titled.add(self.around[i])
        most = {i for i, c in chars.items() if 2 * c > self.total and not (self.plain and i in self.apart)}
        return most | (set() if self.title else titled)


class Open:
    """The open elements, with the places of every name among them."""

    def __init__(self):
        self.names, self.places, self.blocks = [], {}, []  # names; places by name; places of elements that are not inline

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)

    def pop(self) -> str:
        name = self.names.pop()
        self.places[name].pop()
        if name not in INLINE:
            self.blocks.pop()
        return name

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def last(self, names: set[str] | tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def first_after(self, names: set[str], place: int) -> int:
        """The outermost element of one of the names above ``place``, or -1."""
        found = []
        for n in names:
            mine = self.places.get(n, [])
            k = bisect_right(mine, place)
            if k < len(mine):
                found.append(mine[k])
        return min(found, default=-1)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page outside elements that never hold article text, in order, with their paths."""
    named = Named()
    found, nodes = _scan(page, named, set())
    if wrappers := named.wrappers():
        found, nodes = _scan(page, Named(), wrappers)
    if not found and named.words:
        found, nodes = _scan(page, Named(), set(named.words))
    paths: dict[tuple[int, str], int] = {}
    for e in nodes:  # parents come first
        label = e.name if e.own or e.name not in HOLDERS else e.label
        e.path = paths.setdefault((e.parent.path if e.parent else 0, label), len(paths) + 1)
    return found


def _scan(page: str, named: Named, spared: set[int]) -> tuple[list[Block], list[Element]]:
    """One pass over a page; class and id don't count for the elements in ``spared``. Fills ``named``."""
    out: list[Block] = []
    nodes: list[Element] = []
    tags, skips, marks, owners = Open(), [], [], []  # of each open element: whether its text is skipped, the marked element around, the block-level one
    words: list[str] = []
    linked, number, at, n = 0, 0, 0, len(page)
    links = titles = headings = marked = 0  # open elements of a kind
    markup = Markup(page)

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                node = owners[-1] if owners else None
                if node:
                    node.own += 1
                out.append(Block(text, node, linked, headings > 0, marked > 0))
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, titles, headings, marked
        while len(skips) > depth:
            name = tags.names[-1]
            if name not in INLINE:
                flush()
                owners[-1].stop = len(out)
                marked -= owners[-1].name in MARKED
            tags.pop()
            links -= name == "a"
            titles -= name == "h1"
            headings -= name in HEADINGS
            skips.pop(), marks.pop(), owners.pop()

    def text(raw: str) -> None:
        nonlocal linked
        if not raw or skips and skips[-1]:
            return
        own = marks[-1] if marks else 0
        size = 0 if links else len(raw.strip())
        named.total += size
        if own:
            named.chars[own] += size
        if size and not headings and not named.others.get(own, False):
            named.plain += size
        if titles and not raw.isspace():
            if own:
                named.titled.add(own)
            else:
                named.title = True
        if not own:
            if "&" in raw:
                raw = entities.unescape(raw)
            words.append(raw)
            if links:
                linked += len(raw)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        found = markup.tag(start)
        if found is None:  # no tag: text, with what follows up to the next one
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at, end_tag, name, raw = found
        if not name:
            if raw:  # a CDATA section
                text(entities.escape(raw, quote=False))
            continue
        if end_tag:
            place = tags.last((name,))
            if place >= 0 and name in INLINE and tags.blocks and tags.blocks[-1] > place:  # a stray inline end tag doesn't close blocks
                place = -1
            if place >= 0:
                close(place)
            elif name in ("p", "br"):
                flush() if name == "p" else words.append(" ")
            continue
        if name == "br" or name == "wbr":
            if name == "br" and not (skips and (skips[-1] or marks[-1])):
                words.append("\n")
            continue
        if name not in INLINE:
            flush()
            if tags.blocks and tags.names[tags.blocks[-1]] == "p":  # a block ends an open paragraph, with the inline elements inside it
                close(tags.blocks[-1])
            if name in IMPLIED:
                cut = tags.first_after(IMPLIED[name], tags.last(SCOPES[name]))
                if cut >= 0:
                    close(cut)
        if name in VOID or raw.endswith("/") and name not in RAW and name not in CONTAINERS and name not in ("p", "div", "span", "a", "b", "i"):
            continue
        number += 1
        a = _attributes(raw) if raw.strip() and name not in ("body", "html", "main") else {}
        skip = (skips[-1] if skips else False) or name in SKIP or _hidden(a)
        if name == "header":  # a page's header goes; of an article's header only the heading stays
            skip = skip or not marked
        elif not skip and name not in HEADINGS and name not in INLINE and tags.has("header"):
            skip = name not in ("div", "hgroup")
        mark = marks[-1] if marks else 0
        held = {"form"} if name in FORMS else _named(a, name == "article" and not tags.has("article"))
        if held and not skip and number not in spared:
            named.add(number, held, mark, bool(_named(a, True) & FRAME))
            mark = number
        owner = owners[-1] if owners else None
        if name not in INLINE:
            kind = "main" if a.get("role", "").lower() == "main" else name
            owner = Element(kind, owner, f"{kind}.{a.get('class', '')}#{a.get('id', '')}", len(out))
            nodes.append(owner)
            marked += kind in MARKED
        tags.push(name)
        skips.append(skip), marks.append(mark), owners.append(owner)
        links += name == "a"
        titles += name == "h1"
        headings += name in HEADINGS
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    close(0)
    flush()
    return out, nodes


def path_ratios(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Text and punctuation of each block's path, per block of that path."""
    chars, marks, nodes = {}, {}, {}
    for b in found:
        chars[b.path] = chars.get(b.path, 0) + len(b.text) - b.linked
        marks[b.path] = marks.get(b.path, 0) + len(PUNCTUATION.findall(b.text))
        nodes[b.path] = nodes.get(b.path, 0) + 1
    return np.array([max(0, chars[b.path]) / nodes[b.path] for b in found]), np.array([marks[b.path] / nodes[b.path] for b in found])


def path_scores(found: list[Block], reach: int = 2) -> np.ndarray:
    """Fused score of each block: its path's text and punctuation ratios, smoothed over ``reach`` neighbours on both sides."""
    kernel = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2.0)

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(x, kernel, "full")[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]

    text, marks = path_ratios(found)
    return np.sqrt(smooth(text) * (smooth(marks) + 0.1))


def content(found: list[Block], score: np.ndarray) -> np.ndarray:
    """Whether the best block of each block's path reaches the threshold: the mean score, or half of the best one if lower."""
    by_path: dict[int, float] = {}
    for b, s in zip(found, score.tolist()):
        by_path[b.path] = max(by_path.get(b.path, 0.0), s)
    cut = min(float(np.mean(score)), float(np.max(score)) * 0.5)
    return np.array([by_path[b.path] >= cut for b in found])


def extract(page: str | None, share: float = 0.9) -> str:
    """The article's text. If article and main elements hold ``share`` of the selected characters, the rest of the page is not it."""
    found = blocks(page or "")
    if not found:
        return ""
    chosen, alone = content(found, path_scores(found)), content(found, path_scores(found, 0))
    size = np.array([len(b.text) for b in found])
    marked = np.array([b.marked for b in found])
    heads = np.array([b.heading and b.linked * 2 <= len(b.text) for b in found])
    before = np.concatenate([[0], np.cumsum(alone)])  # content blocks up to each block

    def beside(i: int) -> bool:
        """Whether the container of a block holds content too."""
        e = found[i].node and found[i].node.holder
        return e is None or before[e.stop] > before[e.start]

    if size[chosen & marked].sum() >= share * size[chosen].sum():
        held = marked & (chosen | np.array([b.node is not None and b.node.name == "h1" for b in found]))
    else:
        last = int(np.flatnonzero(chosen & alone)[-1]) if (chosen & alone).any() else len(found) - 1
        heads &= np.array([i <= last or beside(i) for i in range(len(found))])
        held = (chosen & alone if (chosen & alone).any() else chosen) | heads
    at = np.flatnonzero(held)
    first, last = int(at[0]), int(at[-1])
    root = found[first].node
    while root is not None and (root.stop <= last or root.name not in HOLDERS):  # a paragraph or list is part of an article, not one
        root = root.parent
    article = root and (root.up({"article"}) or root.up({"main"}))
    root = article or root  # none: the whole page
    out = []
    for i in range(root.start if root else 0, root.stop if root else len(found)):
        b = found[i]
        if not (chosen[i] or b.heading or b.linked * 2 <= len(b.text)):
            continue
        if article or first <= i <= last or beside(i):
            out.append(b.text)
    return "\n".join(out)


def _rows(html_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html_col)
            rest = [i for i in range(batch.num_columns) if i != at]
            texts = [extract(x.as_py()) for x in batch.column(at)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + made, names=[batch.schema.names[i] for i in rest] + ["text", "n_chars"])

    return run


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (columns of those names are replaced)."""
    pages = pages.select(*[F.col(c) for c in pages.columns if c == html_col or c not in ("text", "n_chars")])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html_col]
    return pages.mapInArrow(_rows(html_col), ", ".join([*fields, "text string", "n_chars long"]))
