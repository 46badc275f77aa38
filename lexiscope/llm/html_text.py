"""Main text of web pages, with site templates removed.

A page becomes a tree of elements. What never is main text goes by its tag, role
or its class and id: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Site templates go by
counting: every other element's subtree is hashed, Spark counts the pages of each
host that hold it, and a subtree on ``SHARE`` of a host's pages or more, and on
``LEAST_PAGES`` at least, is deleted wherever it stands. Containers (everything
but running text: paragraphs, headings, lists, tables, quotations) go from
``MANY_PAGES`` and ``LOW_SHARE`` on, as a host has pages of many kinds. Inside an
article running text is not subject to counting: a passage that many articles
share is text, not template.

A name only drops a container beside the text: if the longest article of a page,
or all running text of a page without one, lies in containers dropped by their
class or id, or in a form, these stay, and what is in them is judged piece by
piece. Words within a line and preformatted text are not judged by names at all.

The main text is that of the outermost ``article`` elements; without one that of
``main``, without that of the body. The templates of all hosts stay in Spark when
they are many: the digests of each page are joined with them by host and digest,
and what matches is grouped by page.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.llm.arrow_rows import rows_to, table
from lexiscope.session import checkpoint_dir

LEAST_PAGES = 5
SHARE = 0.5
MANY_PAGES = 20
LOW_SHARE = 0.01
BROADCAST_DIGESTS = 500_000  # digests and hosts of all templates that are sent to every executor
HOST_DIGESTS = 5_000  # templates of one host that are sent along with each of its pages

_TAG = re.compile(r"<(?:!--|(?P<decl>[!?][^>]*+>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
                  r"(?P<attrs>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>)")
_TAG_OPENS = re.compile(r"</?[a-zA-Z]")
_PLAIN_TAG = re.compile(r"<(?:!--|(?P<decl>[!?][^>]*+>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>)")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template".split())
PLAIN = frozenset("b i em strong u s small big font code tt sub sup mark abbr cite q del ins kbd samp var dfn bdi bdo".split())
INLINE = frozenset("a span label time data ruby rb rt rp picture td th".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
                        "figure figcaption address a span time".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside form button select option optgroup datalist input textarea fieldset dialog menu "
                    "svg canvas object audio video map head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                          "toolbar tablist".split())
#: A class or id of one of these words, or with one of them as a part, names something else than main text.
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
                          "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
                          "subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
                          "masthead footer comment comments commentlist disqus respond reply replies related recommended "
                          "share sharing social widget toolbar login search".split())
#: Words that beside one of them still make a boilerplate name: "share-buttons", not "share-prices".
BESIDE_WORDS = DROPPED_WORDS | frozenset("box bar block container wrapper wrap area section list links link button buttons icon icons form "
                                         "panel message unit slot label top bottom left right inline post posts article articles entry "
                                         "content site page main global media thread js".split())
#: Alone these name a part of the text as well.
NOT_ALONE = frozenset("notice notices alert".split())
#: Elements of running text. Their ids are made from headings, so they do not count.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr thead tbody tfoot caption blockquote pre figure figcaption address".split())
#: The parts of a class name that make it one of the page's frame: "site-header", not "article-header".
FRAME = frozenset("site page top main global".split())
NOT_IN_P = frozenset("p div section article main aside nav header footer ul ol dl table form blockquote pre h1 h2 h3 h4 h5 h6 "
                     "figure address details hr fieldset".split())


#: Lists and tables of an article may have a name that is one of these words.
PLAIN_LISTS = frozenset("ul ol dl table".split())
LIST_NAMES = NOT_ALONE | frozenset("menu menus search".split())
#: Why an element is left out: by what it is, or by its name alone.
KEPT, FIRM, NAMED = 0, 1, 2


class Element:
    """``scope`` holds, for each kind of element that a start tag may close, the
    place on the stack of open elements where the nearest one is, or -1."""

    __slots__ = ("tag", "kids", "gone", "inside", "pre", "digest", "scope")

    def __init__(self, tag: str, gone: int, inside: bool, pre: bool = False, scope: tuple = (-1,) * 5):
        self.tag, self.gone, self.inside, self.pre, self.scope = tag, gone, inside, pre, scope
        self.kids: list = []
        self.digest = 0


def _boilerplate_name(name: str) -> bool:
    """All of a class name or id is known boilerplate, not a word of it."""
    words = {w for w in _WORD.findall(name) if not w.isdigit()}
    return bool(words & DROPPED_WORDS) and words <= BESIDE_WORDS and not words <= NOT_ALONE


def _boilerplate(tag: str, attrs: str, inside: bool, pre: bool) -> int:
    """FIRM, NAMED or KEPT."""
    if tag == "form":
        return NAMED
    if tag in DROPPED or tag == "header" and not inside:
        return FIRM
    if not attrs or attrs.isspace():
        return KEPT
    by_name = tag not in ("html", "body", "article", "main") and tag not in INLINE and not pre
    found = KEPT
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return FIRM
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return FIRM
        if name == "role" and value in DROPPED_ROLES:
            return NAMED if value == "form" else FIRM
        if tag == "article" and name == "class" and set(_WORD.findall(value)) & {"comment", "comments", "reply"}:
            return FIRM
        if name not in ("class", "id") or not by_name:
            continue
        if tag in RUNNING and (inside or name == "id") or inside and name == "id" and tag == "section":
            continue
        for one in value.split():
            words = set(_WORD.findall(one))
            if inside and tag in PLAIN_LISTS and words <= LIST_NAMES:
                continue
            if _boilerplate_name(one):
                found = NAMED
            if tag not in RUNNING and "header" in words and (len(words) == 1 and not inside or words & FRAME and words <= BESIDE_WORDS | {"header"}):
                found = NAMED
    return found


#: The groups of ``scope``: elements that a start tag closes, and those that hide them.
_GROUPS = (({"p"}, None), ({"li"}, {"ul", "ol"}), ({"dt", "dd"}, {"dl"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}))
_GROUP_OF = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}


def _scope(tag: str, above: tuple, place: int) -> tuple:
    if tag in INLINE and tag not in ("td", "th"):
        return above
    out = [-1 if tag != "p" else place]
    for (kinds, until), held in zip(_GROUPS[1:], above[1:], strict=True):
        out.append(place if tag in kinds else -1 if tag in until else held)
    if tag in INLINE:  # cells hide no paragraph
        out[0] = above[0]
    return tuple(out)


def parse(page: str) -> Element:
    """The tree of a page, in time linear in its length. Tags that only mark words
    are left out; open elements end with the page. Once a tag does not end because
    of an open quotation mark, tags end at the next ``>``."""
    root = Element("html", KEPT, False)
    stack, at = [root], 0
    opened: dict[str, int] = {}
    last_close, tags = page.rfind(">"), _TAG

    def text(s: str) -> None:
        if s and not s.isspace():
            stack[-1].kids.append(s)
        elif s:
            stack[-1].kids.append(" ")

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    while True:
        start = page.find("<", at)
        if start < 0 or start > last_close:
            text(page[at:])
            break
        m = tags.match(page, start)
        if m is None and tags is _TAG and _TAG_OPENS.match(page, start):
            tags = _PLAIN_TAG
            m = tags.match(page, start)
        if m is None:  # not a tag
            nxt = page.find("<", start + 1)
            text(page[at:nxt] if nxt >= 0 else page[at:])
            if nxt < 0:
                break
            at = nxt
            continue
        text(page[at:start])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["decl"] is None:  # a comment
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
            continue
        name = name.lower()
        if m["end"]:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                close(k)
            continue
        attrs = m["attrs"]
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                stack[-1].kids.append(Element("hr", KEPT, False))
            else:
                stack[-1].kids.append(" ")
            continue
        if name in PLAIN or name in ("html", "body"):
            continue
        if name in NOT_IN_P and stack[-1].scope[0] > 0:
            close(stack[-1].scope[0])
        if name in _GROUP_OF and stack[-1].scope[_GROUP_OF[name]] > 0:
            close(stack[-1].scope[_GROUP_OF[name]])
        parent = stack[-1]
        pre = parent.pre or name == "pre"
        e = Element(name, _boilerplate(name, attrs, parent.inside, parent.pre), parent.inside or name in ("article", "main"), pre,
                    _scope(name, parent.scope, len(stack)))
        parent.kids.append(e)
        if not attrs.rstrip().endswith("/") or name not in ("a", "span", "div", "p"):
            stack.append(e)
            opened[name] = opened.get(name, 0) + 1
    _keep_the_text(root)
    return root


#: An article dropped by a name comes back beside others if it is so many times longer.
LONGER = 3


def _keep_the_text(root: Element) -> None:
    """Take back what names dropped if the page's text is in it."""
    order, todo = [], [(root, -1, 0, -1, False)]
    while todo:  # parents first: element, its parent's place, names above it, place of its article, in a link
        e, above, named, article, link = todo.pop()
        place = len(order)
        named += e.gone == NAMED
        if article < 0 and e.tag in ("article", "main"):
            article = place
        link = link or e.tag == "a"
        if e.gone != FIRM:
            order.append((e, above, named, article, link))
            todo.extend((k, place, named, article, link) for k in e.kids if isinstance(k, Element))
    if not any(e.gone == NAMED for e, *_ in order):
        return
    kept = 0  # characters of running text
    articles: dict[int, int] = {}
    blocks: dict[int, int] = {}
    for place, (e, _, named, article, link) in enumerate(order):
        own = 0 if link else sum(len(k) - k.count(" ") for k in e.kids if isinstance(k, str))
        if article >= 0 and named == order[article][2]:  # what names drop within an article does not count
            articles[article] = articles.get(article, 0) + own
        if not named:
            kept += own
        elif own:
            blocks[place] = own
    if articles:
        place = max(articles, key=lambda p: (articles[p], -p))
        if articles[place] <= LONGER * max((n for p, n in articles.items() if not order[p][2]), default=0):
            return
    elif kept or not blocks:
        return
    else:  # the longest of those under the fewest names
        place = min(blocks, key=lambda p: (order[p][2], -blocks[p]))
    while place >= 0:
        e, place = order[place][0], order[place][1]
        if e.gone == NAMED:
            e.gone = KEPT


def digest_elements(root: Element) -> list[int]:
    """Hash every subtree and return those that may be a site's template: not
    boilerplate by rule, with some text, and no running text of an article. Odd
    numbers are running text."""
    import xxhash
    out: list[int] = []
    order, todo = [], [root]
    while todo:  # parents before children
        e = todo.pop()
        order.append(e)
        todo.extend(k for k in e.kids if isinstance(k, Element))
    full: set[int] = set()
    for e in reversed(order):
        h = xxhash.xxh3_64(e.tag)
        filled = False
        for k in e.kids:
            if isinstance(k, Element):
                h.update(k.digest.to_bytes(8, "little"))
                filled |= id(k) in full
            else:
                s = " ".join(k.split())
                if s:
                    h.update(s)
                    filled = True
        e.digest = h.intdigest() & ~1 | (e.tag in TEXT_BLOCKS)
        if filled:
            full.add(id(e))
            if e is not root and not e.gone and e.tag not in ("article", "main") and not (e.inside and e.tag in TEXT_BLOCKS):
                out.append(e.digest)
    return out


def _roots(root: Element) -> list[Element]:
    """The outermost articles, else mains, else the page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.gone:
                continue
            if e.tag == wanted:
                found.append(e)
            else:
                todo.extend(k for k in reversed(e.kids) if isinstance(k, Element))
        if found:
            return found
    return [root]


def main_text(root: Element, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the main text, one to a line. ``template`` holds digests
    of subtrees to leave out; the digests must have been made."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        block = " ".join(entities.unescape("".join(parts)).split())
        if block:
            blocks.append(block)
        parts.clear()

    for top in _roots(root):
        todo: list = [(top, False)]
        while todo:
            e, heading = todo.pop()
            if e is None:
                flush()
                continue
            if isinstance(e, str):
                if not heading:
                    parts.append(e)
                continue
            if e.gone or e is not top and e.digest in template and e.tag not in ("article", "main") \
                    and not (e.inside and e.tag in TEXT_BLOCKS):
                if e.tag not in INLINE:
                    flush()
                continue
            inline = e.tag in INLINE
            if e.tag in ("td", "th"):
                parts.append(" ")
            if not inline:
                flush()
                todo.append((None, False))
            only = (heading or e.tag == "header") and e.tag not in HEADINGS  # of a header, its headings
            todo.extend((k, only) for k in reversed(e.kids))
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _with_own_templates(base: DataFrame, template: DataFrame, small: bool) -> DataFrame:
    """``base`` with the digests of each page that are templates of its host, by
    joins alone. Pages alike in url and html have the same."""
    keys = ["__url", "__html"]
    keyed = base.withColumn("__url", F.xxhash64("url", F.lit(1), "html")).withColumn("__html", F.xxhash64("html", F.lit(2), "url"))

    def own(part: pa.RecordBatch):
        first, second, hosts, found = [], [], [], []
        for a, b, url, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
            digests = set(digest_elements(parse(page or "")))
            digests.discard(0)
            first.extend([a] * len(digests))
            second.extend([b] * len(digests))
            hosts.extend([host_of(url)] * len(digests))
            found.extend(digests)
        yield pa.RecordBatch.from_arrays(
            [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(hosts, pa.string()),
             pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[*keys, "host", "digest"])

    held = rows_to(keyed.select(*keys, "url", "html"), "html", "__url long, __html long, host string, digest long", own)
    matched = held.join(F.broadcast(template) if small else template, ["host", "digest"], "left_semi")
    lists = matched.groupBy(*keys).agg(F.collect_set("digest").alias("template"))
    return keyed.join(lists, keys, "left")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES,
            low_share: float = LOW_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    A null or empty html has an empty text; a page without a url, or with one
    without a host, belongs to the host ''. Repeated rows each count as a page
    and get the same text; a long page is parsed as a whole, in linear time; an empty
    table gives an empty table; columns other than page_id, url and html are not read."""
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def count(part: pa.RecordBatch):
        hosts, found = [], []
        for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            host = host_of(url)
            own = set(digest_elements(parse(page or "")))
            own.discard(0)
            hosts.extend([host] * (len(own) + 1))
            found.extend(own)
            found.append(0)  # the page itself
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()),
                                          pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["host", "digest"])

    checkpoint_dir(pages.sparkSession)
    counts = rows_to(base.select("url", "html"), "html", "host string, digest long", count) \
        .groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages) \
        .checkpoint()  # read twice below
    total = counts.where("digest = 0").select("host", F.col("n").alias("pages"))
    template = counts.where("digest != 0").join(total, "host").where(
        (F.col("n") >= share * F.col("pages"))
        | (F.col("digest").bitwiseAND(F.lit(1)) == 0) & (F.col("n") >= many_pages) & (F.col("n") >= low_share * F.col("pages"))) \
        .select("host", "digest").checkpoint()
    per_host = template.groupBy("host").count()
    held, longest = per_host.agg(F.coalesce(F.sum(F.col("count") + 1), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if held <= BROADCAST_DIGESTS and longest <= HOST_DIGESTS:
        host = F.lower(F.coalesce(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
        lists = F.broadcast(template.groupBy("host").agg(F.collect_list("digest").alias("template")))
        work = base.withColumn("host", host).join(lists, "host", "left")
    else:  # only those of the page itself
        work = _with_own_templates(base, template, held <= BROADCAST_DIGESTS)
    work = work.select("page_id", "url", "html", "template")
    schema = T.StructType([base.schema["page_id"], base.schema["url"],
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def pull(part: pa.RecordBatch):
        texts = []
        for page, known in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            root = parse(page or "")
            if known:
                digest_elements(root)
                texts.append(main_text(root, {k % (1 << 64) for k in known}))
            else:
                texts.append(main_text(root))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])

    return rows_to(work, "html", schema, pull)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
