import re

import pytest

from tabprobe.llm import html as H

LONG = "A sentence that is long enough to count as the text of an article, with words and commas."
CASES = {
    "semantic": (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1>"
                 f"<p>{LONG}<p>Short.<br>Next&nbsp;  line</p><aside>no</aside><form><input>Search</form><p>a<b>b</b>c &lt;x&gt;</p></article><footer>f</footer></body></html>",
                 f"T & U\n{LONG}\nShort.\nNext line\nabc <x>"),
    "classes": (f"<div class=\"top menu\"><a>Home</a> | <a>B</a></div><div id=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><div class=\"ad-box\">Buy!</div></div>"
                f"<div id=sidebar><p>{LONG}</p></div><section class='reader-comments'><p>{LONG}</p></section><div role=contentinfo>x</div>", f"Head\n{LONG}\nShort."),
    "comments inside": (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}!</p></section></article>", LONG),
    "cookie notice": (f"<div class='cookieNotice'><p>{LONG}?</p></div><main><p>{LONG}</p></main>", LONG),
    "scripts": (f"<script>var t=\"</p><article>\";</script><!-- <p>{LONG} --><p>{LONG}</p><noscript>n</noscript>", LONG),
    "cut": (f"<article><p>{LONG}</p><p>abc <a hr", f"{LONG}\nabc"),
    "unclosed advert": (f"<article><p>{LONG}</p></article><div class=ad>never closed<p>rest", LONG),
    "plain": ("just  text\n with a < b", "just text with a < b"),
    "short": ("<article><p>Hi.</p></article>", "Hi."),
    "links only": ("<article><p><a href=x>only a link</a></p></article>", "only a link"),
    "null": (None, ""), "empty": ("", ""), "nothing": ("<nav>x</nav><footer>y</footer>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert H.main_text(page) == want


WRAPPED = {
    "layout": (f"<div class='layout has-sidebar'><div class=sidebar>Side</div><div class=content><h1>T</h1><p>{LONG}</p></div></div><footer>f</footer>", f"T\n{LONG}"),
    "around an article": (f"<div id=page class=no-sidebar><nav>n</nav><article><p>{LONG}</p></article><section class=comments>c</section></div>", LONG),
    "form": (f"<form action=x><input name=a><p>{LONG}</p><p>Short.</p></form>", f"{LONG}\nShort."),
    "two deep": (f"<div class=no-sidebar><div class='with-header'><p>{LONG}</p></div></div>", LONG),
    "inside main": (f"<main><div class=has-sidebar><article><p>{LONG}</p></article></div></main>", LONG),
    "comments in articles": (f"<article><p>{LONG}</p></article><section class=comments><article><p>{LONG}{LONG}</p></article></section>", LONG),
    "teaser in the footer": (f"<div class=no-sidebar><main><p>{LONG}</p></main></div><footer><article>t</article></footer>", LONG),
    "many comments": (f"<div id=content><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p></div>", LONG),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_marked_wrappers(name):
    page, want = WRAPPED[name]
    assert H.main_text(page) == want


INTERRUPTED = {
    "advert": (f"<p>{LONG}</p><div class=ad>Buy</div><p>Short ending.</p>", f"{LONG}\nShort ending."),
    "title": (f"<body><div id=x><h1>T</h1><div class=share><a>s</a></div><p>{LONG}</p></div><div class=menu>m</div></body>", f"T\n{LONG}"),
    "links at the end": (f"<div><p>{LONG}</p><p><a>One</a></p><p><a>Two</a></p></div>", f"{LONG}\nOne\nTwo"),
    "bare texts": (f"<div>{LONG}</div><div class=cookie>c</div><div>End.</div>", f"{LONG}\nEnd."),
    "link list below": (f"<div><p>{LONG}</p></div><ul><li><a>a</a><li><a>b</a></ul>", LONG),
    "other element": (f"<div><p>{LONG}</p></div><div class=sidebar>s</div><section><p>Legal.</p></section>", LONG),
}


@pytest.mark.parametrize("name", INTERRUPTED)
def test_interrupted_articles(name):
    page, want = INTERRUPTED[name]
    assert H.main_text(page) == want


NAMED = {
    "heading": (f"<article><h2 class='section-header'>Head</h2><p>{LONG}</p></article>", f"Head\n{LONG}"),
    "side by side": (f"<article><p>{LONG}</p><div class='side-by-side'><p>Left</p><p>Right</p></div></article>", f"{LONG}\nLeft\nRight"),
    "share price": (f"<article><p class='share-price'>12.30</p><p>{LONG}</p></article>", f"12.30\n{LONG}"),
    "math": (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", f"{LONG}\nSo x=1 holds."),
    "heading beside menu and advert": (f"<nav><a>Home</a></nav><h1>T</h1><div class=ad>Buy</div><p>Short.</p><p>{LONG}</p><div class=ad>Buy</div><p>End.</p><footer>f</footer>",
                                       f"T\nShort.\n{LONG}\nEnd."),
    "heading of its own": (f"<div><h1>T</h1></div><div>By A.</div><div class=ad>Buy</div><div><p>{LONG}</p></div>", f"T\nBy A.\n{LONG}"),
    "link-heavy share box": (f"<article><p>{LONG}</p><div class='share-box'><a>one</a> <a>two</a></div></article>", LONG),
    "teasers": (f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><article><p>Also read.</p></article>", f"T\n{LONG}\n{LONG}"),
}


@pytest.mark.parametrize("name", NAMED)
def test_names_and_headings(name):
    page, want = NAMED[name]
    assert H.main_text(page) == want


def planted(rng):
    """(page, its article): layouts without article elements, whose menus, link lists and legal
    lines carry no name or element that marks them."""
    para = lambda: " ".join("".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(18, 60))).capitalize() + "."
    blocks = ["Title " + str(rng.randint(0, 999))]
    for _ in range(rng.randint(2, 7)):
        blocks += [para()] + (["Short line."] if rng.random() < 0.3 else [])
    blocks.append(para())
    links = lambda n: [f"<a href=/{i}>Link {i}</a>" for i in range(n)]
    body = "".join(f"<h1>{x}</h1>" if not i else f"<p>{x}</p>" for i, x in enumerate(blocks))
    layout = rng.randint(0, 3)
    if layout == 0:
        page = f"<body><div>{' | '.join(links(6))}</div><div>{body}</div><div>{'<br>'.join(links(9))}</div><div>Imprint 2020</div></body>"
    elif layout == 1:
        page = f"<table><tr><td>{'<br>'.join(links(5))}</td></tr><tr><td>{body}</td></tr><tr><td>{'<br>'.join(links(4))}</td></tr><tr><td>All rights</td></tr></table>"
    elif layout == 2:
        page = f"<ul>{''.join(f'<li>{x}</li>' for x in links(7))}</ul><section>{body}</section><ul>{''.join(f'<li>{x}</li>' for x in links(5))}</ul><section><p>Terms</p></section>"
    else:
        page = f"<div id=a><div id=b>{''.join(f'<div>{x}</div>' for x in links(6))}</div><div id=c>{body}</div><div id=d>{''.join(f'<div>{x}</div>' for x in links(6))}</div><div>Contact us</div></div>"
    return page, "\n".join(blocks)


def test_the_distribution_decides_on_planted_pages(monkeypatch):
    import random
    rng = random.Random(7)
    pages = [planted(rng) for _ in range(200)]
    right = sum(H.main_text(p) == want for p, want in pages)
    monkeypatch.setattr(H, "kept_spans", lambda sizes: [(0, len(sizes))])
    without = sum(H.main_text(p) == want for p, want in pages)
    assert right == 200 and without == 0


def test_surge_and_dive_points():
    assert H.kept_spans([0, 0, 0, 5, 100, 3, 0, 0, 0, 10, 0, 0, 0]) == [(1, 6)]
    assert H.kept_spans([]) == [] and H.kept_spans([0, 0]) == []
    assert H.kept_spans([10, 0, 0, 0, 12]) == [(0, 1), (2, 5)]


def test_long_page_is_kept_whole():
    page = "<article>" + "".join(f"<p>w{i} {LONG}</p>" for i in range(20_000)) + "</article>"
    assert H.main_text(page).count("\n") == 19_999


def test_frame_with_clashing_columns(spark):
    rows = [(i, "u", p, "old", 3, 9) for i, (p, _) in enumerate(CASES.values())] + [(None, None, None, None, None, None), (0, "u", CASES["semantic"][0], "old", 3, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, c0 int").repartition(2)
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "c0", "text", "n_chars"]
    want = [w for _, w in CASES.values()]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["page_id"]] if r["page_id"] is not None else ""
        assert r["text"] == w and r["n_chars"] == len(w)
    assert H.extract(df.limit(0)).collect() == []


def test_known_articles(spark):
    """Test pages hold one article element: its blocks are the text."""
    import html
    import __spark_entry__ as E
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = E.queries()["op6_html_extraction"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]]).group(1)
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\x00", body)).split("\x00")
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
