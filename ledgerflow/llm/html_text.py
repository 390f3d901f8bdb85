"""Main text of HTML pages from the text-to-tag ratio of their lines.

The standard library's streaming parser turns a page into lines, one a block element,
each with its text, its number of tags and the elements that hold it. The ratio of text
to tags by line (Weninger et al., "CETR", 2010) is smoothed by a Gaussian over
neighbouring lines and lines above a threshold form the content clusters. The smallest
element that holds the lines that are in a cluster by a ratio of their own is the content
region, and its lines, without boilerplate elements, are the result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
SKIPPED = frozenset("script style noscript template head title nav header footer aside menu dialog button select option textarea input label iframe svg math object canvas audio video map".split())
#: Words of a class, id or role that mark an element as boilerplate.
MARKS = frozenset(
    "nav navbar navigation menu menus sidebar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions comment comments disqus respond replies reactions feedback "
    "related recommended share sharing social breadcrumb breadcrumbs pagination pager toolbar widget login search complementary contentinfo dialog skip copyright disclaimer outbrain taboola".split()
)
#: Words that say nothing of what an element holds, so a name of them and of marks is a mark.
PLAIN = frozenset(
    "area aside bar block body bottom box btn button buttons card cards center col column container content control count fixed flyout footer form google grid group head header heading "
    "icon icons info inner item items label layer layout left level link links list main message mobile module of off on outer page pane panel part placeholder post posts primary region results "
    "right row secondary section side site slot story stories sub tab text the thread title to top unit user users view visitor reader readers wrap wrapper wide zone banner articles".split()
)
EDGE = re.compile(r"(?:(?:site|page|main|global|top|bottom)[_-])?(?:header|footer|masthead|banner)", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
#: Classes that begin so tell of something elsewhere on the page.
TELLING = ("has-", "with-", "no-", "is-", "not-")


def mark(name: str) -> int:
    """2 for a class, id or role that marks boilerplate, 1 if only a part of it does, 0 if none does."""
    if name.startswith(TELLING):
        return 0
    parts = [w.lower() for w in PARTS.findall(name)]
    if EDGE.fullmatch(name) or any(w in MARKS for w in parts) and all(w in MARKS or w in PLAIN or len(w) == 1 for w in parts):
        return 2
    return int(any(w.lower() in MARKS for w in re.split(r"[_-]", name)))


UNENDED = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
#: Elements whose end is left out where the next begins.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
HOLDERS = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in a head; any other one ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


class Lines(HTMLParser):
    """Lines of a page: (text, tags, element, whether links hold it all), skipped elements left out; elements know their parents.

    A form or an element with a marked class, id or role is only noted here: whether its lines
    count is known when all have been read. Time and memory are linear in the page, however
    deep its elements stand in each other.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # name, element, skipped with all it holds, begins what is skipped or marked
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements by name
        self.blocks: list[int] = []  # places of open blocks
        self.stops: list[int] = []  # and of blocks and elements that begin what is skipped or marked
        self.lines: list[tuple[str, int, int, bool]] = []
        self.kinds, self.parents, self.marks = [""], [0], [0]  # by element, 0 for the page: name, parent, nearest marked one around it
        self.marked: list[int] = []
        self.partly: set[int] = set()  # those with a mark in a part of a name only
        self.text: list[tuple[str, int, bool]] = []  # piece, element, in a link
        self.tags = 0

    def flush(self) -> None:
        """Ends the line. What inline marked elements hold in it is a line of its own."""
        by_marks: dict[int, tuple[list[str], int, list[bool]]] = {}
        for piece, element, link in self.text:
            pieces, _, links = by_marks.setdefault(self.marks[element], ([], element, []))
            pieces.append(piece)
            links.append(link or piece.isspace())
        for pieces, element, links in by_marks.values():
            text = " ".join("".join(pieces).split())
            if text:
                self.lines.append((text, self.tags, element, all(links)))
        if self.text:
            self.tags = 0
        self.text = []

    def add(self, piece: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.text.append((piece, self.open[-1][1] if self.open else 0, bool(self.at["a"])))

    def close_to(self, k: int) -> None:
        for name, *_ in self.open[k:]:
            self.at[name].pop()
        del self.open[k:]
        for places in (self.blocks, self.stops):
            while places and places[-1] >= k:
                places.pop()

    def end_head(self, everything: bool) -> None:
        """A head whose end tag is left out ends at the body and before anything that can't stand in it."""
        if self.at["head"] and (everything or self.open[-1][0] == "head"):
            self.close_to(self.at["head"][-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in IN_HEAD:
            self.end_head(tag == "body")
        if tag in BLOCKS:
            self.flush()
            # A paragraph ends where a block begins; so do list items and cells. Blocks in an
            # inline element that doesn't count belong to it; a new paragraph or item ends it.
            around = self.blocks if tag == "p" or tag in HEADINGS or tag in CLOSED_BY else self.stops
            if around:
                name = self.open[around[-1]][0]
                if name == "p" or name in HEADINGS and tag in HEADINGS or tag in CLOSED_BY and name in CLOSED_BY[tag]:
                    self.close_to(around[-1])
        if tag in VOID:
            if tag == "br":
                self.add(" ")
            return
        held = bool(self.open and self.open[-1][2])
        names = [c for a, v in attrs if a in ("class", "id", "role") and v for c in v.split()]
        marks = max(map(mark, names), default=0)
        hidden = any(a == "hidden" or a == "aria-hidden" and v == "true" or a == "style" and v and re.search(r"display\s*:\s*none", v, re.I) for a, v in attrs)
        # The header of an article holds its title.
        skipped = held or tag in SKIPPED and not (tag == "header" and self.at["article"]) or hidden
        marked = not skipped and (
            tag == "form" or tag not in ("html", "body", "main") and marks > 0 or tag == "article" and any("comment" in c.lower() for c in names)
        )
        begins = skipped and not held or marked
        if begins and tag not in BLOCKS and self.text:
            # An inline element that doesn't count mustn't end the line it stands in.
            self.add(" ")
        element, parent, place = len(self.kinds), self.open[-1][1] if self.open else 0, len(self.open)
        self.kinds.append(tag)
        self.parents.append(parent)
        self.marks.append(element if marked else self.marks[parent])
        if marked:
            self.marked.append(element)
            if marks == 1 and tag != "form":
                self.partly.add(element)
        self.at[tag].append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in BLOCKS or begins:
            self.stops.append(place)
        self.open.append((tag, element, skipped, begins))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.add(" ")
            return
        if tag in BLOCKS:
            self.flush()
        places = self.at[tag]
        if places and (tag in BLOCKS or not self.blocks or self.blocks[-1] <= places[-1]):
            self.close_to(places[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def with_children(self, values: dict[int, float]) -> np.ndarray:
        """By element: the sum of ``values`` over it and all it holds. Children have higher numbers than parents."""
        total = [0.0] * len(self.kinds)
        for e, v in values.items():
            total[e] += v
        for e in range(len(total) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return np.array(total)

    def within(self, chosen: np.ndarray) -> np.ndarray:
        """By element: how many of the ``chosen`` elements hold it or are it."""
        n = [int(x) for x in chosen]
        for e in range(1, len(n)):
            n[e] += n[self.parents[e]]
        return np.array(n)

    def region_of(self, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """By line, with ``at`` its element: whether it is in the smallest holder of all ``wanted`` lines and between its outer parts."""
        if not wanted.any():
            return np.ones(len(at), dtype=bool)
        held = self.with_children(sums_by(at, wanted))
        # Of the elements that hold all wanted lines the deepest has the highest number.
        holder = np.isin(np.array(self.kinds), tuple(HOLDERS))
        regions = np.flatnonzero(holder & (held == held[0]))
        region = int(regions[-1]) if len(regions) else 0
        part = list(range(len(self.kinds)))  # by element within the region: the child of the region that holds it
        for e in range(1, len(part)):
            if self.parents[e] != region:
                part[e] = part[self.parents[e]]
        outer = np.array(part)[at]
        first, last = np.flatnonzero(wanted)[[0, -1]]
        ends = (np.arange(len(at)) < first) | (np.arange(len(at)) > last)
        inside = self.within(np.arange(len(self.kinds)) == region)[at] > 0
        return inside & ~(ends & holder[outer] & (outer != region) & (held[outer] == 0))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head(False)
        self.add(data)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """``x`` under a Gaussian of ``sigma`` lines, with weights that add up to one at the edges."""
    r = max(1, int(3 * sigma))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    mid = slice(r, r + len(x))
    return np.convolve(x, g)[mid] / np.convolve(np.ones(len(x)), g)[mid]


def clusters(size: np.ndarray, tags: np.ndarray, sigma: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of lines with their lengths and tags: which are in clusters, and which would be without their neighbours."""
    own = size / np.maximum(1, tags)
    ratio = smoothed(own, sigma)
    return ratio >= threshold * ratio.mean(), own >= threshold * own.mean()


def before_headings(wanted: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """``wanted`` lines with the headings right above them."""
    out = wanted.copy()
    for k in range(len(out) - 2, -1, -1):
        out[k] |= out[k + 1] and heading[k]
    return out


def sums_by(elements: np.ndarray, values: np.ndarray) -> dict[int, float]:
    out: dict[int, float] = defaultdict(float)
    for e, v in zip(elements, values, strict=True):
        out[int(e)] += float(v)
    return out


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5, most: float = 0.8) -> str:
    """The blocks of the main text, joined by line feeds.

    Lines whose smoothed ratio reaches ``threshold`` times the mean are clusters; the
    region is the smallest element with all of their lines that reach it by their own ratio too (or half of what is usual
    in clusters) and the headings above them. Parts of the region before the first or after the last of these
    that hold none of them (a menu, a footer) don't belong to it. ``article`` and ``main``
    are one region, with the headings above, if they hold ``most`` of the clusters' text together. Marked elements and forms are left out
    unless they hold more than half of the clusters' text, or more than ``most`` of it where
    an ``article`` or ``main`` stands beside them. An element with a mark in a part of a name only (``ad-hoc``) is left
    out only if none of its lines reaches the threshold by its own ratio. Character references are decoded, white space
    becomes one space. Broken markup is read as far as it goes; nothing is cut.
    """
    p = Lines()
    p.feed(html or "")
    if UNENDED.match(p.rawdata):  # a tag or comment that the page's end cuts off isn't text
        p.rawdata = ""
    p.close()
    p.flush()
    if not p.lines:
        return ""
    texts, tags, at, linked = (list(x) for x in zip(*p.lines, strict=True))
    size, tags, at, linked = np.array([len(t) for t in texts], dtype=float), np.array(tags), np.array(at), np.array(linked)
    kinds, marks = np.array(p.kinds), np.array(p.marks)
    named = np.isin(kinds, ("article", "main"))
    content, strong = clusters(size, tags, sigma, threshold)
    if p.marked:
        # A mark on an element with most of the page's cluster text is on a wrapper of the page.
        cluster = p.with_children(sums_by(at[content], size[content]))
        beside = named & (p.with_children(sums_by(at, marks[at] == 0)) > 0)
        around = p.within(beside)
        whole = cluster[0]
        own = p.with_children(sums_by(at, strong)) if p.partly else None
        dropped = np.zeros(len(kinds), dtype=bool)
        for e in p.marked:
            if e in p.partly:
                dropped[e] = own[e] == 0
            else:
                dropped[e] = cluster[e] <= (most if beside.sum() > around[e] else 0.5) * whole
        left = p.within(dropped)[at] == 0
        texts = [t for t, ok in zip(texts, left, strict=True) if ok]
        size, tags, at, linked = size[left], tags[left], at[left], linked[left]
        if not texts:
            return ""
        content, strong = clusters(size, tags, sigma, threshold)
    heading = p.within(np.isin(kinds, tuple(HEADINGS)))[at] > 0
    inside = p.within(named)[at] > 0
    if float(size[inside & content].sum()) >= most * float(size[content].sum()):
        # The title right above an article belongs to it.
        chosen = before_headings(inside, heading)
    else:
        # What is in a cluster by its neighbours alone doesn't widen the region, nor does an article without
        # text of its own (a teaser); a heading belongs to the content that follows it.
        teaser = named & (p.with_children(sums_by(at, strong)) == 0)
        ratio = size / np.maximum(1, tags)
        usual = content & ~linked & (ratio >= threshold * np.median(ratio[content])) if content.any() else content
        wanted = before_headings(content & (strong | usual) & (p.within(teaser)[at] == 0), heading)
        chosen = p.region_of(at, wanted)
    return "\n".join(t for t, ok in zip(texts, chosen, strict=True) if ok)


def add_main_text(df: DataFrame, html: str = "html", carry_html: bool = False) -> DataFrame:
    """Adds ``main_text``: the main text of each page, '' for a null, empty or textless page.

    Repeated rows are read each; an empty table gives an empty one; an input column
    ``main_text`` is replaced. One page at a time is in memory, whole.
    """
    df = df.drop("main_text")
    fields = [f for f in df.schema.fields if carry_html or f.name != html]
    names = [f.name for f in fields] + ["main_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(t) for t in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), texts], names=names)

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("main_text", T.StringType())]))
