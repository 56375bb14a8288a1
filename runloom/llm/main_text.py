"""The main text of web pages by a minimum cut.

A page is cut into blocks, the texts between block-level tags. A linear classifier gives every block a
score from where it stands and how it reads; a positive score is the capacity from the source (the
cost of calling the block boilerplate), a negative one the capacity to the sink (the cost of calling it
content). Neighbouring blocks, and blocks under one element, are joined by smoothness edges: elements
are nodes of the graph too, tied to what they hold, so that proximity in the document needs as many
edges as the page has elements. Maximum flow finds the cheapest cut; blocks on the source's side are
the main text.
"""

from __future__ import annotations

import html
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.batches import (
    flat_computed,
    fresh,
    name_column,
    text_column,
    whole_texts,
    with_computed,
)

# What HTML counts as blocks, as tags without an end, as tags that hold raw text up to their end tag or
# the end of the page, and as tags whose inside is no text of the page where they have an end tag.
BLOCKS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir
div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th
thead tr ul video audio canvas iframe object svg title""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("iframe template svg select".split())
# Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"br", "option", "caption", "td", "th", "tr", "body", "html", "button"}
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
            "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# The classifier: tags and words of class, id and role, and their weights.
AROUND = frozenset("nav header footer aside form menu button dialog fieldset label".split())
WITHIN = frozenset("article main".split())
NOISE = frozenset("""ad ads advert advertisement advertising adverts banner banners breadcrumb breadcrumbs
comment comments commentlist consent cookie cookies copyright disqus dialog footer form gdpr header login
masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination
popup promo promoted recommended related respond reply replies rss search share sharing sidebar signup
skip social sponsor sponsored subscribe tags teaser toolbar widget widgets contentinfo complementary
navigation reader reactions alert warning""".split())
# On an article or main element only these count: "has-sidebar" there does not make it a sidebar.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())
W_START, W_LENGTH, W_SENTENCE, W_LINKS, W_WITHIN = -0.6, 1.8, 0.6, -3.0, 3.0
W_AROUND, W_NOISE, W_GOOD, W_HEADING, W_ITEM = -9.0, -7.0, 0.8, -0.2, -0.5
NEXT, UNDER = 0.35, 0.25  # capacities of smoothness edges
LONG = 25  # words at which a block's length has said what it can

# A quote opens a value only behind "=", and its value goes on to the same quote, however far; one that
# is never closed opens nothing.
_TOKEN = re.compile(r"""<!--(?:.*?)(?:-->|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>
    |<[!?/][^>]*+>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_READ = frozenset("class id role style hidden aria-hidden".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]]*\s*$")


class Element:
    """An open element: its place in the graph and what it says about the blocks inside."""

    __slots__ = ("tag", "node", "score", "within", "around")

    def __init__(self, tag, node, score, within, around):
        self.tag, self.node, self.score, self.within, self.around = tag, node, score, within, around


class Page:
    """Blocks of a page with scores, and the edges of its graph."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.parents: list[int] = []
        self.element_parent: list[int] = [-1]
        self._open = [Element("", 0, 0.0, False, False)]
        self._parts: list[str] = []
        self._linked = 0
        self._links = 0
        self._endless: set[str] = set()  # tags that have no end tag further on
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            self._text(source[at:found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if found["end"]:
                self._close(tag)
            elif (tag in RAW or tag in SKIPPED) and not found["rest"].endswith("/"):
                end = None
                if tag not in self._endless:
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                if end is None:
                    self._endless.add(tag)
                if end is None and tag in SKIPPED:
                    self._start(tag, found["rest"])
                    continue
                if tag in BLOCKS:
                    self._flush()
                at = end.end() if end else len(source)
            else:
                self._start(tag, found["rest"])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            self._parts.append(raw)
            if self._links:
                self._linked += len(raw)

    def _start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self._links = 1
        if tag not in BLOCKS:
            return
        self._flush()
        if tag in EMPTY:
            return
        if tag in WITHIN:  # an unclosed menu or header does not hold the article
            for i, element in enumerate(self._open):
                if element.tag in AROUND:
                    del self._open[i:]
                    break
        elif tag in ENDS_PARAGRAPH and self._open[-1].tag == "p":
            self._open.pop()
        if tag in SIBLINGS:
            for i in range(len(self._open) - 1, 0, -1):
                if self._open[i].tag in SIBLINGS[tag]:
                    break
                if self._open[i].tag == tag:
                    del self._open[i:]
                    break
        self._push(tag, rest)

    def _push(self, tag: str, rest: str) -> None:
        above = self._open[-1]
        score, within, around = above.score, above.within, above.around
        if tag in WITHIN:
            within = True
        if tag in AROUND and not around:
            score, around = score + W_AROUND, True
        if rest and tag not in ("html", "body"):
            for name, value in _ATTRIBUTE.findall(rest):
                name = name.lower()
                if name not in _READ:
                    continue
                if name in ("class", "id", "role"):
                    words = {w.lower() for w in _WORDS.findall(value)}
                    if words & (COMMENTS if tag in WITHIN else NOISE) and not around:
                        score, around = score + W_NOISE, True
                    elif words & GOOD:
                        score += W_GOOD
                elif not around and (name == "hidden" or (name == "aria-hidden" and "true" in value)
                                     or name == "style" and re.search(r"display\s*:\s*none", value)):
                    score, around = score + W_AROUND, True
        node = len(self.element_parent)
        self.element_parent.append(above.node)
        self._open.append(Element(tag, node, score, within, around))

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._links = 0
            return
        if tag not in BLOCKS:
            return
        self._flush()
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                del self._open[i:]
                return

    def _flush(self) -> None:
        if not self._parts:
            return
        raw = "".join(self._parts)
        linked, self._linked, self._parts = self._linked, 0, []
        text = _SPACE.sub(" ", html.unescape(raw)).strip()
        if not text:
            return
        inside = self._open[-1]
        words = text.count(" ") + 1
        score = W_START + inside.score + W_LENGTH * min(words, LONG) / LONG
        score += W_SENTENCE * bool(_SENTENCE.search(text)) + W_LINKS * min(1.0, linked / len(raw))
        score += W_WITHIN * inside.within
        score += W_HEADING * (inside.tag[:1] == "h" and inside.tag[1:].isdigit())
        score += W_ITEM * (inside.tag in ("li", "td", "dt", "dd"))
        self.texts.append(text)
        self.scores.append(score)
        self.parents.append(inside.node)

    def main_text(self) -> str:
        """The blocks on the source's side of the minimum cut, joined by one space."""
        count = len(self.texts)
        if not count:
            return ""
        edges = [(i, i + 1, NEXT) for i in range(count - 1)]
        # Only elements with blocks below them, and one node for each chain of single children.
        used = {p for p in self.parents}
        for p in list(used):
            while p > 0:
                p = self.element_parent[p]
                if p in used:
                    break
                used.add(p)
        node = {e: count + i for i, e in enumerate(sorted(used))}
        edges += [(i, node[p], UNDER) for i, p in enumerate(self.parents)]
        edges += [(node[e], node[self.element_parent[e]], UNDER) for e in used if e > 0]
        content = minimum_cut(self.scores + [0.0] * len(node), edges)
        return " ".join(t for t, kept in zip(self.texts, content[:count], strict=True) if kept)


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    A positive score is the capacity from the source to a node, a negative one that from the node to
    the sink; edges hold their capacity either way. Maximum flow by levels (Dinic): shortest ways
    are filled until none is left. Of equal cuts the one with the fewest nodes on the sink's side.
    """
    count = len(scores)
    source, sink = count, count + 1
    heads: list[list[int]] = [[] for _ in range(count + 2)]
    to: list[int] = []
    left: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        left.append(forth)
        heads[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, score in enumerate(scores):
        if score > 0:
            join(source, i, score, 0.0)
        elif score < 0:
            join(i, sink, -score, 0.0)
    for a, b, capacity in edges:
        join(a, b, capacity, capacity)
    tiny = 1e-12
    while True:
        level = [-1] * (count + 2)
        level[source] = 0
        waiting = deque([source])
        while waiting and level[sink] < 0:
            a = waiting.popleft()
            for e in heads[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    waiting.append(to[e])
        if level[sink] < 0:
            break
        following = [0] * (count + 2)
        way: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in way)
                cut = None
                for i, e in enumerate(way):
                    left[e] -= flow
                    left[e ^ 1] += flow
                    if cut is None and left[e] <= tiny:
                        cut = i
                a = to[way[cut] ^ 1]
                del way[cut:]
                continue
            while following[a] < len(heads[a]):
                e = heads[a][following[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(heads[a]):
                way.append(heads[a][following[a]])
                a = to[way[-1]]
            elif way:
                e = way.pop()
                a = to[e ^ 1]
                following[a] += 1
            else:
                break
    # What cannot reach the sink any more is content.
    out = [True] * (count + 2)
    out[sink] = False
    waiting = deque([sink])
    while waiting:
        b = waiting.popleft()
        for e in heads[b]:
            a = to[e]
            if out[a] and left[e ^ 1] > tiny:
                out[a] = False
                waiting.append(a)
    return out[:count]


def main_text(source: str) -> str:
    return Page(source).main_text()


def extract(pages: DataFrame, into: str = "text") -> DataFrame:
    """``pages`` plus the main text of every whole html; a null html is empty and has none.

    All rows and columns stay; if ``into`` is taken, the new column gets underscores at its end.
    """
    out = fresh(pages, into)

    def start():
        return lambda sources: [[main_text(s) for s in whole_texts(sources)]]

    return with_computed(pages, ["html"], [T.StructField(out, T.StringType())], start)


def query_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none), n_chars of every row of ``pages``."""
    rows = pages.select(name_column("page_id").alias("page_id"), name_column("url").alias("url"),
                        text_column("html").alias("html"))
    fields = [*rows.schema.fields[:2], T.StructField("text", T.StringType())]

    def start():
        return lambda ids, urls, sources: (ids, urls, [main_text(s) for s in sources])

    return flat_computed(rows, fields, start).withColumn("n_chars", F.length("text").cast("long"))
