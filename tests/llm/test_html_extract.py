import html
import re

import pytest

from lodestack.llm import html_extract, queries

LONG = "This is a sentence of the article, with commas, and it goes on for a while. " * 4
PAGE = f"""<!doctype html><html><head><title>T</title><style>p>a{{}}</style><script>if (a</b>1) x="<p>";</script></head>
<body class="has-sidebar"><header class=site><a href=/>Home</a><h1>Site</h1></header>
<div id="cookie-consent">We use cookies, dear reader. Accept?</div><div role="navigation"><a>one</a> <a>two</a></div>
<div class="wrap"><aside>Latest posts</aside>
<div class="entry-content"><h2>Head &amp; title</h2><p>{LONG}<b>bold</b>&nbsp;&#233;<br>next
line</p><ul><li>First item, short<li>Second item</ul><div class="ad-slot"><p>Buy, buy, buy now!</p></div>
<table><tr><td>a<td>b</table><p>{LONG}<p>Short.<form><input value=x><p>mail</p></form><blockquote>Quoted, indeed.</blockquote></div>
<section id="comments"><p>{LONG} I disagree, said a reader.</p></section><div class="related"><p>More, more.</p></div></div>
<footer>&copy; all</footer></body></html>"""


def squash(s):
    return " ".join(s.split())


def test_article_of_a_full_page():
    one = squash(html.unescape(LONG))
    want = ["Head & title", one + " bold é next line", "First item, short", "Second item", "a", "b", one, "Short.", "Quoted, indeed."]
    assert html_extract.extract(PAGE).split("\n") == want


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "<script>x", "<nav>a</nav>", "<!-- never closed", "</div></p>", "<p></p>", "&", '<a href="x'])
def test_pages_without_an_article(page):
    got = html_extract.extract(page)
    assert got == ("&" if page == "&" else {"<": "<", "<p": "<p", '<a href="x': '<a href="x'}.get(page, ""))


def test_malformed_and_long():
    assert html_extract.extract("<p>One, two.<p>Three &lt;b&gt; four &amp five") == "One, two.\nThree <b> four & five"
    assert html_extract.extract("<div><p>x</div>" * 3) == "x\nx\nx"
    deep = "<div>" * 3000 + "<p>Deep text, here.</p>"
    assert html_extract.extract(deep) == "Deep text, here."
    words = "word, " * 200_000
    assert html_extract.extract(f"<article><p>{words}</p></article>") == squash(words)


def test_pages_without_an_article_element_keep_every_selected_block():
    one = squash(LONG)
    ten = f"<p>{LONG}</p>" * 10
    want = ["Title", "lead", *[one] * 10]
    for page in (f"<div class=post><h1>Title</h1><p>lead</p><div class=body>{ten}</div></div>", f"<h1>Title</h1><p>lead</p><div>{ten}</div>"):
        assert html_extract.extract(f"<body>{page}</body>").split("\n") == want
        assert html_extract.extract(page).split("\n") == want
    assert html_extract.extract(f"<body><section>{LONG * 9}</section><section>Short one, here.</section></body>").endswith("\nShort one, here.")
    assert html_extract.extract(f"<body><main><h1>Title</h1><p>lead</p><article>{ten}</article></main><div>No, not this.</div></body>").split("\n") == want
    assert html_extract.extract(f"<body><article>{ten}</article><article><p>Short one, here.</p></article></body>").endswith("\nShort one, here.")
    menu = "<div><ul>" + "<li><a href=/x>Go there</a></li>" * 5 + "</ul></div>"
    assert html_extract.extract(f"<body>{menu}<div><h2>Title</h2><div>{ten}</div></div></body>").split("\n") == ["Title", *[one] * 10]


def test_class_names_of_wrappers_and_topics_lose_nothing():
    one = squash(LONG)
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = ["Title", one, one]
    for tag in ('article class="post category-legal tag-search"', 'div class="layout sidebar-right"', 'div id="search-page"', 'div class="menu"', 'section class="legal"'):
        end = tag.split()[0]
        for around in ("", '<div class="ad">Buy, buy, buy now!</div>', "<div><a href=/>Home</a></div>"):
            assert html_extract.extract(f"<body>{around}<{tag}>{body}</{end}></body>").split("\n") == want
    assert html_extract.extract(f'<body><div class="search-wrap"><div class="legal-page">{body}<div class="ad-slot">Buy!</div></div></div></body>').split("\n") == want
    assert html_extract.extract('<body><div class="post-banner"><h1>Title</h1></div>' + body[14:] + "</body>").split("\n") == want
    posts = f'<article class="post tag-search"><p>{LONG}</p></article><article class="post"><p>{LONG}</p></article><div class="category-legal"><p>{LONG}</p></div>'
    assert html_extract.extract(f"<body>{posts}</body>").split("\n") == [one] * 3


def test_long_text_by_others_stays_out():
    for name in ("comments", "comments-area", "cookie-consent", "related", "ad"):
        page = f'<body><div class="layout sidebar-right"><h1>Title</h1><p>One short line, here.</p><div id="{name}"><p>{LONG * 5}</p></div></div></body>'
        assert html_extract.extract(page).split("\n") == ["Title", "One short line, here."]
    page = f'<body><div class="masthead"><h1>Site</h1></div><article><h1>Title</h1><p>{LONG}</p></article></body>'
    assert html_extract.extract(page).split("\n") == ["Title", squash(LONG)]


def test_a_main_element_by_role_and_the_frame_of_a_short_page():
    one = squash(LONG)
    page = f'<body><div role="main"><h1>Title</h1><p>{LONG}</p><div>short</div></div><div role="complementary"><p>{LONG}</p></div></body>'
    assert html_extract.extract(page).split("\n") == ["Title", one, "short"]
    for name in ("footer", "nav", "pager"):
        page = f'<body><div id="content"><h1>T</h1><p>Short one, here.</p></div><div id="{name}">Copyright, all rights.</div></body>'
        assert html_extract.extract(page).split("\n") == ["T", "Short one, here."]
    assert html_extract.extract(f'<body><div class="footer"><h1>Title</h1><p>{LONG}</p></div></body>').split("\n") == ["Title", one]
    assert html_extract.extract(f'<body><article><p>{LONG}</p><ins class="adsbygoogle">Buy!</ins></article></body>') == one


def test_columns_without_telling_names():
    one = squash(LONG)
    article = f'<div class="c1"><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>The end.</p></div>'
    want = ["Title", one, "Short.", one, "The end."]
    side = '<div class="c2"><h3>Latest</h3><p>First one</p><p>Second one</p></div>'
    for page in (article + side, side.replace("h3", "p") + article, article + "<div>Copyright 2020</div>", article + side + "<div>Copyright 2020</div>", f"<div>{article}{side}</div>"):
        assert html_extract.extract(f"<body>{page}</body>").split("\n") == want
    assert html_extract.extract(f'<body><article><p>{LONG}</p><p class="legal-term">A term.</p><div class="x">Last.</div></article></body>').split("\n")[-1] == "Last."
    assert html_extract.extract(f'<body><div><p>{LONG}</p><div class="a">Between.</div><p>{LONG}</p><p>Last.</p></div></body>').split("\n") == [one, "Between.", one, "Last."]


@pytest.mark.parametrize("tag", ['article class="post comments-open"', 'div class="layout-sidebar-left"', 'div id="social-science"', 'article class="post category-legal"'])
def test_named_wrappers_keep_the_article(tag):
    page = f"<body><{tag}><article><h1>Title</h1><p>{LONG}</p></article></{tag.split()[0]}></body>"
    assert html_extract.extract(page).split("\n") == ["Title", squash(LONG)]


def test_a_form_around_the_page_is_no_form_of_the_article():
    for page in (f'<form id="aspnetForm"><article><h1>Title</h1><p>{LONG}</p></article></form>', f"<form><div><h1>Title</h1><p>{LONG}</p><form><p>Your mail?</p></form></div></form>"):
        assert html_extract.extract(f"<body>{page}</body>").split("\n") == ["Title", squash(LONG)]
    assert html_extract.extract(f"<body><form><p>Your mail, please?</p></form><article><h1>Title</h1><p>{LONG}</p></article></body>").split("\n") == ["Title", squash(LONG)]


def test_time_is_linear_in_tags_and_depth():
    import time

    n = 100_000
    pages = ["<div>x" * n, "<ul><li>x" * n, "<li>x" * n, "<p>x" * n, "<b>x" * n, '<a "' * n, '<a "' * n + ">", "<a x='" * n, "<a x=\"" * n + "'>", "<" * n, "<!" * n, "</" * n + ">", "<div class=ad>x" * n, "<td>x" * n, "</b>" * n, "<div><b>" * n + "</b>" * n, "<![CDATA[x" * n]
    for page in pages:
        began = time.process_time()
        html_extract.extract(page)
        assert time.process_time() - began < 20, page[:20]


def plain_scores(rows, reach):
    """Scores of (path, text, linked) rows by loops."""
    import math

    def ratio(i, of):
        mine = [of(t, k) for p, t, k in rows if p == rows[i][0]]
        return max(0, sum(mine)) / len(mine)

    out = []
    for i in range(len(rows)):
        parts = []
        for of in (lambda t, k: len(t) - k, lambda t, k: sum(c in ".,;:!?…。，、！？¿¡" for c in t)):
            near = [(math.exp(-0.5 * (j - i) ** 2), ratio(j, of)) for j in range(max(0, i - reach), min(len(rows), i + reach + 1))]
            parts.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        out.append(math.sqrt(parts[0] * (parts[1] + 0.1)))
    return out


def test_path_ratios_equal_plain_loops():
    page = f"<body><ul><li><a>go</a><li><a>there</a> now</ul><div class=a><p>{LONG}</p><p>One, two.</p></div><div class=b><p>x</p><p>{LONG}!</p></div>tail"
    found = html_extract.blocks(page)
    names = ["body/ul/li"] * 2 + ["body/div.a/p"] * 2 + ["body/div.b/p"] * 2 + ["body"]
    assert [names.index(x) for x in names] == [[b.path for b in found].index(b.path) for b in found]
    rows = [(p, b.text, k) for p, b, k in zip(names, found, [2, 5, 0, 0, 0, 0, 0])]
    for reach in (0, 2):
        assert html_extract.path_scores(found, reach).tolist() == pytest.approx(plain_scores(rows, reach))


def test_smoothed_scores_prefer_text_paths():
    found = html_extract.blocks("<body><div><p>" + LONG + "</p><p>" + LONG + "</p></div><ul>" + "<li><a>go</a></li>" * 9 + "</ul></body>")
    score = html_extract.path_scores(found)
    assert min(score[:2]) > 3 * max(score[5:])


def test_whole_table_against_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op1_html_text(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        parts = re.sub(r"<[a-z/][^>]*>", "", re.sub(r"<br>", "\n", re.sub(r"</?(p|h1)>", "\0", inner))).split("\0")
        want = "\n".join(t for t in (squash(html.unescape(x)) for x in parts) if t)
        r = got[p.page_id]
        assert (r.text, r.n_chars, r.url) == (want, len(want), p.url)


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "<p>Hi, you.</p>", "t"), (1, None, "<p>Hi, you.</p>", "t"), (None, "u", None, None)], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_extract.main_text(df).collect()), key=str)
    assert got == [(1, None, "Hi, you.", 8), (1, None, "Hi, you.", 8), (None, "u", "", 0)]
    assert html_extract.main_text(df.limit(0)).collect() == []
