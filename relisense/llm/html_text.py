"""Main text of HTML pages by minimum-cut labelling of their blocks.

The nodes of a page's graph are its text blocks and the elements around them that their tag
or attributes mark (``article``, ``nav``, a class such as ``comments``). A block's capacities
to the two terminals are the costs that a fixed classifier of its text alone gives to calling
it content or boilerplate; a marked element's are what its marks speak for, for every block
in it. Smoothness edges join each block to the marked element around it, marked elements to
each other, and neighbouring blocks, the weaker the farther they lie apart in the tree. The
minimum cut (by max-flow) is the labelling of least total cost, so a mark is evidence that
the blocks inside may outweigh, and a short line is judged by what is around it.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.llm.shared import in_parts

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody textarea tfoot thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text; the first ones end with the page if they aren't closed, the others count only if they are.
RAW_TAGS = frozenset("script style xmp iframe noframes noembed".split())
SKIPPED_TAGS = frozenset("noscript template object svg math canvas audio video".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog button select textarea option label head title legend datalist".split())
#: Elements whose id says what they are for; ids of headings and paragraphs come from their words.
ID_TAGS = frozenset("div section ul ol dl table header".split())
#: Words in class, id or role that speak for boilerplate, for content, or for neither.
BOILER_WORDS = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination paywall popup privacy promo promotion promoted recommended related replies reply respond rail share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar warning widget alert complementary contentinfo search".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story".split())
PLAIN_WORDS = frozenset("area bar block bottom box button col column container form group header inner item items left link links list outer page panel right row section site slot text title top unit wrap wrapper".split())
#: Evidence of marks, for each block inside. All text evidence of a block is below MARKED.
MARKED, BY_ID, HIDDEN, ARTICLE, MAIN, CONTENT_CLASS = 8.0, 6.0, 9.0, 3.0, 2.0, 3.0
#: Evidence against blocks outside of the article, on pages that have one; the stronger one where the
#: article's own text is worth at least ARTICLE_SHARE of what is outside.
OUTSIDE, OUTSIDE_SURE, ARTICLE_SHARE = 2.5, 6.0, 0.2
#: A form, or an element that a class, id or role marks, says nothing about its blocks if it holds this share of
#: the page's text evidence (of ENOUGH at least): it is a wrapper of the page. Comments may be that long.
WRAPPER_SHARE, ENOUGH = 0.8, 12.0
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond discussion".split())
#: Words that are also subjects: inside an article, an element of such a name is judged by its text.
SUBJECT_WORDS = frozenset("social legal privacy search warning related copyright".split())
#: Inside running text these are part of it.
INLINE_CONTROLS = frozenset("button label".split())
PROSE_TAGS = frozenset("p li dd blockquote h1 h2 h3 h4 h5 h6 figcaption td".split())
#: Edges: of a block and the marked element around it; of content inside boilerplate and of boilerplate inside
#: content, for each block of the inner element (UNSURE where its mark is a partial one); of neighbouring blocks.
GOVERNED, CONTENT_INSIDE, BOILER_INSIDE, UNSURE, ADJACENT = 6.0, 8.0, 1.5, 3.0, 1.5
#: Blocks that are farther apart in the tree have no edge.
FAR = 12

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES_P = BLOCK_TAGS - {"button", "option", "optgroup", "select", "textarea", "caption", "legend", "tbody", "thead", "tfoot", "tr", "title", "head", "body", "html"}
_SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr", ("table",)), "option": ("option", ("select",))}
_P_STOPS = ("div", "section", "article", "aside", "nav", "main", "header", "footer", "form", "body", "li", "blockquote", "table", "button")
_SLASH_P_STOPS = ("div", "section", "article", "body", "li", "td")


@dataclass(slots=True)
class Element:
    tag: str
    up: Element | None
    depth: int
    #: Evidence for each block inside that it is content, and that it is boilerplate.
    content: float
    boiler: float
    article: bool
    main: bool
    #: Whether it may be a wrapper of the whole page whatever its mark.
    wrapper: bool = False
    #: The nearest marked element, this one included.
    mark: Element | None = None


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _named(value: str) -> tuple[float, float]:
    """Shares of the telling names in a class or id that speak for content and for boilerplate.

    A name of several words speaks for boilerplate as far as those of its words do that
    say anything at all; next to names for content it counts for less.
    """
    content, boiler, telling = 0.0, 0.0, 0
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if bad := len(words & BOILER_WORDS):
            boiler += bad / (bad + len(words - BOILER_WORDS - CONTENT_WORDS - PLAIN_WORDS))
            telling += 1
        elif not words.isdisjoint(CONTENT_WORDS):
            content += 1
            telling += 1
    content, boiler = content / max(telling, 1), boiler / max(telling, 1)
    return content, boiler * (1 - content)


def _element(tag: str, attrs: str, up: Element | None) -> Element:
    article = bool(up and up.article)
    content = ARTICLE if tag == "article" else MAIN if tag == "main" else 0.0
    boiler = MARKED if tag in BOILER_TAGS or tag == "header" and not article else 0.0
    wrapper = tag == "form" or not boiler
    if attrs and tag not in ("html", "body"):
        for k, v in _ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'")
            if k in ("class", "role") or k == "id" and tag in ID_TAGS:
                good, bad = _named(v)
                words = {w.lower() for w in _WORD.findall(v)}
                wrapper = wrapper and words.isdisjoint(COMMENT_WORDS)
                if article and words & BOILER_WORDS <= SUBJECT_WORDS:
                    bad /= 4
                content = max(content, CONTENT_CLASS * good)
                boiler = max(boiler, (BY_ID if k == "id" else MARKED) * bad)
            elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and "display:none" in v.replace(" ", "").lower():
                boiler, wrapper = HIDDEN, False
    made = Element(tag, up, up.depth + 1 if up else 0, content, boiler, article or tag == "article", bool(up and up.main) or content > 0, wrapper)
    made.mark = made if content or boiler else up.mark if up else None
    return made


class _Open:
    """The open elements, with their places by name, so that closing one never walks the tree."""

    def __init__(self):
        self.path = [Element("", None, 0, 0.0, 0.0, False, False)]
        self.places: dict[str, list[int]] = {}

    @property
    def here(self) -> Element:
        return self.path[-1]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.path))
        self.path.append(e)

    def close(self, names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Leaves the nearest open element of these names, unless a stop lies nearer."""
        nearest = lambda tags: max((p[-1] for t in tags if (p := self.places.get(t))), default=0)
        if (at := nearest(names)) and at > nearest(stop):
            for e in reversed(self.path[at:]):
                self.places[e.tag].pop()
            del self.path[at:]


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with white space folded and character references decoded."""
    tree = _Open()
    out: list[Block] = []
    block: Block | None = None
    around: Block | None = None  # the block that a marked inline element interrupts
    links = 0
    endless: set[str] = set()  # skipped tags of which no end follows
    inline = dict.fromkeys(INLINE_CONTROLS, 0)  # open controls that are part of running text

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(tree.here)
        if "&" in raw:
            raw = html.unescape(raw)
        block.parts.append(raw)
        if links:
            block.linked += len(raw)

    def end() -> None:
        nonlocal block, around
        for b in (around, block):
            if b is not None:
                b.text = " ".join("".join(b.parts).split())
                if b.text:
                    out.append(b)
        block = around = None

    at = 0
    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[6]
        if tag is None or not (m[4] or m[8]):  # a comment, or cut off by the end of the page
            continue
        tag, attrs, closing = tag.lower(), m[3] or m[7] or "", m[1] or m[5]
        if not closing and (tag in RAW_TAGS or tag in SKIPPED_TAGS):
            if not attrs.endswith("/") and tag not in endless:
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page) if tag in RAW_TAGS else at
                if stop is None:
                    endless.add(tag)
            continue
        if tag in INLINE_CONTROLS:
            if closing and inline[tag]:
                inline[tag] -= 1
                continue
            if not closing and block is not None and tree.here.tag in PROSE_TAGS and any(not x.isspace() for x in block.parts):
                inline[tag] += 1
                continue
        if tag in ("td", "th", "br", "wbr", "img"):
            if tag != "wbr" and block is not None:
                block.parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in BLOCK_TAGS:
            end()
            if closing:
                tree.close((tag,), _SLASH_P_STOPS if tag == "p" else ())
                continue
            if tag in _CLOSES_P:
                tree.close(("p",), _P_STOPS)
            if tag in _SELF_CLOSING:
                names, stop = _SELF_CLOSING[tag]
                tree.close(tuple(names.split()), stop)
            if tag not in VOID_TAGS:
                tree.push(_element(tag, attrs, tree.here))
        elif closing:
            if tree.here.tag == tag:  # of a marked inline element: what it interrupted goes on
                inner, block = block, None
                resumed, around = around, None
                if inner is not None:
                    block = inner
                    end()
                block = resumed
                tree.close((tag,))
        elif tag not in VOID_TAGS and (attrs or tag in BOILER_TAGS):
            made = _element(tag, attrs, tree.here)
            if made.boiler >= MARKED:  # a block of its own
                if around is None:
                    block, around = None, block
                else:
                    end()
                tree.push(made)
    text(page[at:])
    end()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling it content, cost of calling it boilerplate), from the block's text and own tag."""
    n = len(b.text)
    density = min(1.0, b.linked / n)
    marks = sum(b.text.count(c) for c in ".,;:!?")
    content = 0.5 + 4.0 * density * density + (1.2 if n < 25 and not marks else 0.6 if n < 25 else 0.0)
    own = 0.7 if b.element.tag in ("p", "blockquote", "pre") else 0.5 if b.element.tag in ("h1", "h2", "h3") else 0.0
    return content, 3.0 * (1 - 2.0 ** (-n / 40)) * (1 - density) + min(marks, 4) * 0.2 + own


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements; FAR if they are that far apart or more."""
    n = 0
    while a is not b and n < FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut (Dinic's algorithm).

    source[i] and sink[i]: capacities to the terminals; edges: capacity from the first node to
    the second (cut where only the first is on the source's side), and back.
    Among minimum cuts the source's side is the smallest.
    """
    n = len(source)
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # this much flows straight through
        if source[i] > both:
            arc(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            arc(i, t, sink[i] - both, 0.0)
    for a, b, c, back in edges:
        arc(a, b, c, back)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if cap[k] > 1e-9 and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                first = next(i for i, k in enumerate(path) if cap[k] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while nxt[a] < len(out[a]):
                k = out[a][nxt[a]]
                if cap[k] > 1e-9 and level[to[k]] == level[a] + 1:
                    path.append(k)
                    a = to[k]
                    break
                nxt[a] += 1
            else:
                if not path:
                    break
                k = path.pop()
                a = to[k ^ 1]
                nxt[a] += 1


def graph(blocks: list[Block]) -> tuple[list[float], list[float], list[tuple[int, int, float, float]]]:
    """(costs of content, costs of boilerplate, edges) of the blocks, then of the marked elements around them."""
    content, boiler = map(list, zip(*map(costs, blocks), strict=True))
    inside = [b.element.article or b.element.main for b in blocks]
    worth = [max(0.0, b - c) for b, c in zip(boiler, content, strict=True)]
    own = sum(w for w, i in zip(worth, inside, strict=True) if i)
    if any(inside):
        against = OUTSIDE_SURE if own >= ARTICLE_SHARE * (sum(worth) - own) else OUTSIDE
        content = [c + against * (not i) for c, i in zip(content, inside, strict=True)]
    edges = []
    for i in range(1, len(blocks)):
        if (far := tree_distance(blocks[i - 1].element, blocks[i].element)) < FAR:
            edges.append((i - 1, i, ADJACENT / (1 + far), ADJACENT / (1 + far)))
    marks: dict[int, int] = {}  # node of each marked element
    elements: list[Element] = []
    for b in blocks:
        e = b.element.mark
        while e is not None and id(e) not in marks:
            marks[id(e)] = len(blocks) + len(elements)
            elements.append(e)
            e = e.up.mark if e.up else None
    held = [0] * len(elements)  # blocks inside
    text, article = [0.0] * len(elements), [0.0] * len(elements)  # what they are worth, and those in an article
    for i, b in enumerate(blocks):
        if b.element.mark is not None:
            k = marks[id(b.element.mark)]
            held[k - len(blocks)] += 1
            text[k - len(blocks)] += worth[i]
            article[k - len(blocks)] += worth[i] * inside[i]
            edges.append((k, i, GOVERNED, GOVERNED))
    for e in sorted(elements, key=lambda e: -e.depth):  # inner ones first
        k, outer = marks[id(e)], e.up.mark if e.up else None
        if outer is not None:
            n = held[k - len(blocks)]
            at = marks[id(outer)] - len(blocks)
            held[at] += n
            text[at] += text[k - len(blocks)]
            article[at] += article[k - len(blocks)]
            edges.append((marks[id(outer)], k, n * (UNSURE if 0 < e.boiler < BY_ID else BOILER_INSIDE), n * CONTENT_INSIDE))
    whole = sum(worth)
    wraps = [e.wrapper and whole >= ENOUGH and t >= WRAPPER_SHARE * whole and own - a <= (1 - WRAPPER_SHARE) * whole for e, t, a in zip(elements, text, article, strict=True)]
    content += [e.boiler * n * (not w) for e, n, w in zip(elements, held, wraps, strict=True)]
    boiler += [e.content * n for e, n in zip(elements, held, strict=True)]
    return content, boiler, edges


def labelled(page: str | None) -> tuple[list[Block], list[bool]]:
    """The blocks of a page, and which of them are content."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return [], []
    content, boiler, edges = graph(blocks)
    # on the source's side: content; cutting an arc from the source costs what boilerplate costs
    return blocks, min_cut(boiler, content, edges)[: len(blocks)]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a line feed; empty for null, empty or text-free pages."""
    blocks, keep = labelled(page)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. Repeated rows and null ids stay; columns
    beside the three named are not read; an empty table gives no rows. A null page, or one
    without text, has the empty text. Long pages are read whole, in time linear in their
    length but for the cut; among cuts of equal cost the one with least content is taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            text = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
