"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block of text, in page order. Navigation,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts
and styles are recognised by element name, role, class or id and leave empty
lines behind; an element so marked that wraps the article stays, and only the
marked parts inside it go. The text lengths (link texts count nothing) are summed over a
sliding window of ``WINDOW`` lines; a surge is where the sums rise from zero and
reach ``min(SURGE, half the page's largest sum)``, the dive where they fall back
to zero. The text between surge and dive points is kept, whole. An article or
main element is bounded by empty lines, and what is stripped inside it, or
between blocks of one and the same element, leaves none, so one article is one
stretch; lines of links only (but for lists of links) go with text before them in
the same element; if a page has such an element, only its
lines count. A page's heading (h1) above the first stretch belongs to it, with the
lines between. Names of classes, ids and roles count as whole words; as the first or last part of a
name only those that are unmistakable do, any other only if the element holds links
mostly. Headings are never stripped for their names, other prose elements only for a whole one.

Scale: row-wise over whole pages; a page is read once.

Defined results: null or empty html and pages without text give an empty text;
unclosed and truncated markup is read as far as it goes; repeated rows give
repeated results; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

_RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|object|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_HEAD = re.compile(r"(?is)<head\b[^>]*>.*?</head\s*>")
_TAG = re.compile(r"""(?s)<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""")
_NAMED = re.compile(r"""(?is)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead tr ul""".split())
_HOLDERS = frozenset("html body div section article main td th form fieldset center header footer aside nav".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STRIPPED = frozenset("nav header footer aside form button menu dialog fieldset label input".split())
_ARTICLE = frozenset(("article", "main"))
#: never around an article that no article or main element marks
_NO_WRAPPERS = frozenset("nav header footer aside button menu dialog label".split())
#: names in class, id and role values that mark what is not the article
_MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar
    navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside complementary contentinfo comment comments
    commentlist respond reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter
    subscribe subscription signup login search share sharing social related recommended widget toolbar pagination pager copyright
    disclaimer skip""".split())
#: those that also mark as the first or last part of a name (``ad-box``, ``reader-comments``); the others do so
#: only for what consists of links mostly
_PARTS = frozenset("""ad ads adv advert adverts advertisement sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs
    footer sidebar comment comments commentlist disqus cookie cookies consent gdpr notice notices notification newsletter popup
    modal pagination pager""".split())
#: elements of prose: only a whole name marks them, and none marks a heading
_PROSE = frozenset("p pre blockquote li dd dt td th tr tbody table figure figcaption span b i em strong code math".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _marked(element: str, attributes: str) -> int:
    """2: class, id or role mark the element as not the article; 1: if it holds links mostly; 0: no mark."""
    out = 0
    if element in _HEADINGS:
        return out
    for _, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            if name.lower() in _MARKS:
                return 2
            if element in _PROSE:
                continue
            parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
            if parts and (parts[0] in _PARTS or parts[-1] in _PARTS or parts[-2:] in (["site", "header"], ["page", "header"], ["top", "header"])):
                return 2
            if parts and (parts[0] in _MARKS or parts[-1] in _MARKS):
                out = 1
    return out


def link_free(own: str, words: str) -> bool:
    """Whether a block has text of its own: signs between links are none."""
    return own == words or any(map(str.isalnum, own))


def lines(page: str | None) -> list[tuple[str, int, bool, bool]]:
    """(text, its length without link texts, inside an article, in the page's heading)
    by block; empty lines stand for what was stripped."""
    text = _HEAD.sub(" ", _RAW.sub(" ", page or ""))
    out: list[tuple[str, int, bool, bool]] = []
    buf: list[str] = []
    plain: list[str] = []
    homes: list[tuple[int, ...]] = []  # by line: the elements whose block it is
    gaps: list[tuple[int, int]] = []  # (lines before it, element around it) of stripped elements
    around, made = [(0, "")], 1  # open elements that hold blocks
    bare = listed = False  # directly in the last of them; in a list
    article = link = heading = 0
    at = 0
    skip: str | None = None  # element being stripped
    depth = 0

    def close():
        if buf:
            words = " ".join(html.unescape("".join(buf)).split())
            if words:
                own = " ".join(html.unescape("".join(plain)).split())
                size = len(own) if link_free(own, words) else 0
                out.append((words, size, article > 0, heading > 0))
                homes.append(() if listed and not size else tuple(x for x, _ in around[-2 if bare else -1:]))
            buf.clear()
            plain.clear()

    tags = list(_TAG.finditer(text))
    n = len(tags)
    ends = _ends(tags)
    bad = _unwanted(text, tags, ends)
    standing = _standing(text, tags, ends, bad)
    k = 0
    while k < n:
        m = tags[k]
        k += 1
        piece = text[at:m.start()]
        at = m.end()
        if skip is None and piece:
            buf.append(piece)
            if not link:
                plain.append(piece)
        name = (m.group(2) or "").lower()
        if not name:
            continue
        ending = m.group(1) == "/"
        if skip is not None:
            if name == skip:
                depth += -1 if ending else 1
                if depth == 0:
                    skip = None
            continue
        if bad[k - 1] and k - 1 not in standing:
            close()
            if not article:
                gaps.append((len(out), around[-1][0]))
            if ends[k - 1] >= 0:
                skip, depth = name, 1
            else:  # never closed: up to the next block
                while k < n and (tags[k].group(2) or "").lower() not in _BLOCKS:
                    k += 1
                at = tags[k].start() if k < n else len(text)
            continue
        if name == "a":
            link = 0 if ending else 1
            if ending:
                continue
        if name in _BLOCKS:
            close()
            link = 0
            if name in _ARTICLE:
                article = max(0, article + (-1 if ending else 1))
                if article == (0 if ending else 1):
                    gaps.append((len(out), -1))
            if name in ("ul", "ol", "menu"):
                listed = not ending
            if name == "h1":
                heading = 0 if ending else 1
            if name not in _HOLDERS:
                bare = False
            elif not ending:
                around.append((made, name))
                made, bare = made + 1, True
            elif any(x == name for _, x in around):
                while around.pop()[1] != name:
                    pass
                bare = False
    if skip is None and at < len(text):
        rest = re.sub(r"<[a-zA-Z/!][^>]*\Z", "", text[at:])  # a tag cut off at the page's end
        buf.append(rest)
        plain.append(rest)
    close()
    return _with_gaps(out, homes, gaps)


def _with_gaps(out, homes, gaps):
    """The lines with empty ones where something was stripped, but for between
    blocks of one element; there lines of links only count once text came."""
    first: dict[int, int] = {}  # by element: its first and last line of text, the last one of any kind
    last: dict[int, int] = {}
    for i, mine in enumerate(homes):
        for x in mine:
            if out[i][1]:
                first.setdefault(x, i)
            last[x] = i
    lines, k = [], 0
    for i in range(len(out) + 1):
        while k < len(gaps) and gaps[k][0] == i:
            home = gaps[k][1]
            if home < 0 or first.get(home, i) >= i or last[home] < i:
                lines.extend([("", 0, False, False)] * WINDOW)
            k += 1
        if i < len(out):
            words, size, inside, head = out[i]
            if not size and any(first.get(x, i) < i for x in homes[i]):
                size = 1
            lines.append((words, size, inside, head))
    return lines


def _unwanted(text: str, tags, ends: list[int]) -> list[bool]:
    """By tag: starts an element that is stripped, unless it wraps the article."""
    out, weak = [], []
    for i, m in enumerate(tags):
        name = (m.group(2) or "").lower()
        mark = 0
        if name and m.group(1) != "/" and name not in _VOID and name not in _ARTICLE and name not in ("html", "body"):
            mark = 2 if name in _STRIPPED else _marked(name, m.group(3))
        out.append(mark == 2)
        if mark == 1 and ends[i] >= 0:
            weak.append(i)
    if weak:  # text and text outside links before each tag
        every, plain, link, at = [0], [0], False, 0
        for m in tags:
            size = len(" ".join(text[at:m.start()].split()))
            at = m.end()
            every.append(every[-1] + size)
            plain.append(plain[-1] + (0 if link else size))
            if (m.group(2) or "").lower() == "a":
                link = m.group(1) != "/"
        for i in weak:
            j = ends[i]
            out[i] = 2 * (plain[j + 1] - plain[i + 1]) <= every[j + 1] - every[i + 1]
    return out


def _ends(tags) -> list[int]:
    """The end tag of each start tag (-1: none), by elements of one name."""
    out = [-1] * len(tags)
    waiting: dict[str, list[int]] = {}
    for i, m in enumerate(tags):
        name = (m.group(2) or "").lower()
        if m.group(1) != "/":
            waiting.setdefault(name, []).append(i)
        elif waiting.get(name):
            out[waiting[name].pop()] = i
    return out


def _standing(text: str, tags, ends: list[int], bad: list[bool]) -> set[int]:
    """Start tags of marked elements that wrap the page's article.

    On a page whose article and main elements all lie in marked elements these
    are the ones around a main element, or else around an article. Elsewhere it
    is one that holds most of the text outside links (of the article, inside
    one) and leaves next to nothing beside it, or holds the page's heading."""
    n = len(tags)
    found = [(i, ends[i]) for i, m in enumerate(tags) if ends[i] >= 0 and bad[i]]
    if not found:
        return set()
    every, inside, heads = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # before each tag: text, text inside articles, headings
    articles, mains, free, depths = [0] * (n + 1), [0] * (n + 1), 0, [0] * n
    depth, link, at, until = 0, False, 0, -1
    for i, m in enumerate(tags):
        size = 0 if link else len(" ".join(text[at:m.start()].split()))
        at = m.end()
        name, ending = (m.group(2) or "").lower(), m.group(1) == "/"
        every[i + 1], inside[i + 1] = every[i] + size, inside[i] + (size if depth else 0)
        heads[i + 1] = heads[i] + (name == "h1" and not ending)
        articles[i + 1] = articles[i] + (name in _ARTICLE and not ending)
        mains[i + 1] = mains[i] + (name == "main" and not ending)
        if name == "a":
            link = not ending
        elif name in _BLOCKS:
            link = False
        depths[i] = depth
        if ends[i] >= 0 and bad[i]:
            until = max(until, ends[i])
        if name in _ARTICLE:
            free += not ending and i > until
            depth = max(0, depth + (-1 if ending else 1))
    sums = inside if free else every
    held = {(i, j): sums[j + 1] - sums[i + 1] for i, j in found}
    # the text left when the elements with at most half of the text go
    left, covered, k = [0] * (n + 1), -1, 0
    small = [x for x in found if 2 * held[x] <= sums[n]]
    for i in range(n):
        left[i + 1] = left[i] + (0 if i <= covered else sums[i + 1] - sums[i])
        while k < len(small) and small[k][0] <= i:
            covered, k = max(covered, small[k][1]), k + 1
    out = set()
    for i, j in found:
        if articles[n] and not depths[i]:
            if not free and (mains[j] > mains[i] if mains[n] else articles[j] > articles[i]):
                out.add(i)
        elif (tags[i].group(2) or "").lower() not in _NO_WRAPPERS and 2 * held[i, j] > sums[n]:
            beside = left[n] - (left[j + 1] - left[i + 1])
            if heads[j] > heads[i] or beside < (1 if depths[i] else SURGE):
                out.add(i)
    return out


def kept_spans(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(surge line, dive line) of the stretches to keep: runs of nonzero window
    sums that reach the threshold somewhere."""
    n = len(sizes)
    sums = [sum(sizes[i:i + window]) for i in range(n)]
    if not sums or max(sums) == 0:
        return []
    high = min(surge, (max(sums) + 1) // 2)
    out, i = [], 0
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if max(sums[i:j]) >= high:
            out.append((i, j))
        i = j
    return out


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by line feeds."""
    found = lines(page)
    if any(x[2] for x in found):  # an article element: nothing outside it belongs to the text
        found = [x if x[2] else ("", 0, False, False) for x in found]
        # inside it a line made of links only is text too
        sizes = [max(x[1], 1) if x[0] else 0 for x in found]
    else:
        sizes = [x[1] for x in found]
    # the window sees a surge ahead: the stretch begins with its first line of text
    spans = [(next((k for k in range(i, j) if sizes[k]), j), j) for i, j in kept_spans(sizes)]
    spans = with_heading(spans, [x[3] for x in found])
    return "\n".join(x[0] for i, j in spans for x in found[i:j] if x[0])


def with_heading(spans: list[tuple[int, int]], heads: list[bool]) -> list[tuple[int, int]]:
    """The first stretch reaches up to a heading above it, over gaps and short lines."""
    above = [i for i in range(spans[0][0]) if heads[i]] if spans else []
    return [(above[0], spans[0][1]), *spans[1:]] if above else spans


def _task(schema):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x) for x in part.column("_html").to_pylist()]
                rest = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], schema=schema)
    return run


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the html) with ``text`` and ``n_chars``; input
    columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType
    cols = [c for c in (keep or pages.columns) if c not in (html_col, "text", "n_chars")]
    names = [f"c{i}" for i in range(len(cols))]
    src = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names)], F.col(html_col).cast("string").alias("_html"))
    kind = StructType([*src.schema.fields[:-1]]).add("_text", StringType())
    out = src.mapInArrow(_task(to_arrow_schema(kind)), kind)
    return out.select(*[F.col(n).alias(c) for c, n in zip(cols, names)], F.col("_text").alias("text"),
                      F.length("_text").cast("long").alias("n_chars"))
