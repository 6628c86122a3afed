"""Main text of web pages by tag-path ratios.

A block is a stretch of text between block elements; its path is the chain of tags
and classes from the root to its block element. All blocks of a page with one path
share its ratios: their mean length in letters and digits outside links, their mean
number of punctuation marks, and the share of their letters and digits that stand
outside links. Along the page the product of the first two is smoothed, so that a
short paragraph between long ones counts as they do, and fused with the raw ratio.

Thresholds on paths then select the text:

1. Paths whose fused score reaches CONTENT standard deviations are content. The
   article and main elements that hold most of it, or else the lowest container
   of all of it, are where the text is.
2. Of the blocks there, those stay whose path has a share of PLAIN outside links;
   what is made of links (next page, buy now, a list of other pages) is a menu.

Before that, elements that the task names go: by tag or role, menus, headers,
footers, sidebars, notices and forms; by class or id made of such names alone, these
and adverts and reader comments. An element that holds the article or most of the
text never goes by its name.

Everything is linear in the page: elements are numbered in page order, a path is a
number, and sums over subtrees are one pass from the last element to the first.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.words import sliced

CONTENT = 0.5  # standard deviations that a content path's score reaches
PLAIN = 0.1  # share of a path's letters and digits outside links

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/<>]*)|(!--)|([!?/]))")
_STOP = re.compile("[>\"']")
_ATTRS = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = re.compile(r"class|id|role|hidden|style", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，…\"'()¿¡]")
_MARKS = re.compile(r"[\W_]+")
_LONG_REFERENCE = re.compile(r"&#0*[1-9][0-9]{7,};?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# What HTML calls things, and what pages commonly do.
RAW = set("script style textarea title iframe noscript template svg math object select canvas audio video".split())
ENDLESS = {"script", "style", "textarea"}  # without an end tag they go on to the page's end
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
LEFT_OUT = set("nav footer aside button head menu dialog label input search fieldset datalist".split())
NAMES_LEFT_OUT = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side aside footer foot header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments reply replies respond disqus related recommended".split()
)
# Readers may write more than the article's author.
COMMENTS = set("comment comments reply replies respond disqus".split())
# Words that go with those in one name ("site-footer"); any other word makes it another thing's name ("related-work").
NAMES_BESIDE = set(
    "site page main global top bottom left right primary secondary sticky fixed mobile desktop inner outer wrapper wrap container box block section area region "
    "bar list item items links link posts articles stories content form buttons button icons icon row col column group holder unit slot inline main post entry article user".split()
)
# Whose headers and footers are text of the article.
ARTICLE_WORDS = set("article post entry content".split())
ROLES_LEFT_OUT = set("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
HOMES = ("article", "main")
SECTIONS = ("article", "main", "section", "div", "center", "body", "html")
PROSE = set("p blockquote pre h1 h2 h3 h4 h5 h6 b i em strong span a code q cite small mark".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _is_left_out(name: str) -> bool:
    """Whether a class or id is made of names that are left out, and words that go with them."""
    words = {w.lower() for w in _NAME.findall(name)}
    if words & ARTICLE_WORDS and words & NAMES_LEFT_OUT <= {"header", "head", "footer", "foot"}:
        return False
    return name.lower() in NAMES_LEFT_OUT or bool(words & NAMES_LEFT_OUT) and words <= NAMES_LEFT_OUT | NAMES_BESIDE


def _decoded(raw: str) -> str:
    """raw with its character references decoded; numbers beyond all code points become the replacement character."""
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", re.sub(r"&#0+(?=[0-9])", "&#", raw))) if "&" in raw else raw


class _Element:
    """An element; what it has from its ancestors is known when it opens."""

    __slots__ = ("tag", "parent", "depth", "path", "left_out", "named", "comments", "home", "top", "link", "head", "block", "box", "p", "sum", "sum_home", "out", "inside", "branch", "first")

    def __init__(self, tag: str, parent: "_Element | None", attrs: str, paths: dict):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.home = tag in HOMES or bool(parent and parent.home)
        self.top = parent and parent.top or (self if tag in HOMES else None)  # the outermost article or main element
        self.left_out = bool(parent and parent.left_out) or tag in LEFT_OUT or tag == "header" and not (parent and parent.home)
        self.named = tag == "form"  # left out by its name or role, unless it holds the article
        self.comments = False
        self.link = tag == "a" or bool(parent and parent.link)
        self.head = tag in HEADINGS or bool(parent and parent.head)
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.box = self if tag in BLOCK and tag != "p" or parent is None else parent.box
        self.p = self if tag == "p" else None if tag in BLOCK or parent is None else parent.p  # the open paragraph
        self.sum = self.sum_home = 0
        self.out = self.inside = False
        self.branch: _Element | None = None
        self.first: _Element | None = None  # the block element of the first block in it
        style = self._read(attrs) if attrs and _READ.search(attrs) else ""
        key = (parent.path if parent else -1, tag, style)
        self.path = paths.setdefault(key, len(paths))

    def _read(self, attrs: str) -> str:
        """Take notice of attributes; returns the class."""
        seen: dict[str, str] = {}
        for key, a, b, c in _ATTRS.findall(attrs):
            seen.setdefault(key.lower(), _decoded(a or b or c))
        if self.tag not in ("html", "body", *HOMES) and not (self.home and self.tag in PROSE):
            names = [n for n in f"{seen.get('class', '')} {seen.get('id', '')}".split() if _is_left_out(n)]
            self.named = self.named or bool(names)
            self.comments = any(COMMENTS & {w.lower() for w in _NAME.findall(n)} for n in names)
        self.named = self.named or seen.get("role", "").strip().lower() in ROLES_LEFT_OUT
        hidden = "hidden" in seen or seen.get("aria-hidden", "").strip().lower() == "true"
        self.left_out = self.left_out or hidden or bool(_HIDING.search(seen.get("style", "")))
        return seen.get("class", "")


class _Reader:
    """Reads a page once, from its start to its end."""

    def __init__(self, page: str):
        self.page, self.paths = page, {}
        self.root = self.at = _Element("html", None, "", self.paths)
        self.elements = [self.root]
        self.open: dict[str, int] = defaultdict(int)  # open elements by tag
        self.number = 0  # of the block
        self.nodes: list[tuple[_Element, str, int]] = []
        self.broken = False  # a quote was not closed: tags end at the next ">"
        self.endless: set[str] = set()  # raw elements that have no end tag any more
        self._run()

    def _text(self, start: int, end: int) -> None:
        if end > start:
            raw = self.page[start:end]
            if not raw.isspace():
                self.nodes.append((self.at, _decoded(raw), self.number))
            elif self.nodes and self.nodes[-1][2] == self.number:
                self.nodes.append((self.at, " ", self.number))

    def _tag_end(self, pos: int) -> int:
        """Where the tag ends whose attributes start at pos; -1 if nowhere."""
        page, at = self.page, pos
        end = page.find(">", pos) + 1
        if not end or self.broken:
            return end or -1
        if page.find('"', pos, end) < 0 and page.find("'", pos, end) < 0:
            return end
        while True:
            found = _STOP.search(page, at)
            if found is None:
                break
            at = found.end()
            if found[0] == ">":
                return at
            # A quote counts after an equals sign.
            if page[pos : found.start()].rstrip()[-1:] == "=" if found.start() - pos < 64 else page[found.start() - 64 : found.start()].rstrip()[-1:] == "=":
                close = page.find(found[0], at)
                if close < 0:
                    break
                at = close + 1
        self.broken = True
        return end

    def _close(self, to: _Element) -> None:
        """Close `to` and all that is open in it."""
        while True:
            self.open[self.at.tag] -= 1
            done, self.at = self.at, self.at.parent
            if done is to:
                return

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body") and (tag == "html" or self.open["body"]):
            return
        if tag in BLOCK:
            self.number += 1
        if tag in CLOSES:
            while self.at.box.tag in CLOSES[tag]:
                self._close(self.at.box)
        if tag in CLOSES_P and self.at.p is not None:
            self._close(self.at.p)
        if tag not in VOID and not attrs.endswith("/"):
            self.at = _Element(tag, self.at, attrs, self.paths)
            self.elements.append(self.at)
            self.open[tag] += 1

    def _run(self) -> None:
        page, pos, done = self.page, 0, 0
        while (found := _OPEN.search(page, pos)) is not None:
            slash, tag, comment, other = found.groups()
            tag = (tag or "").lower()
            if comment:
                end = page.find("-->", found.end() - 2) + 3
                end = end if end > 2 else len(page)
            else:
                end = page.find(">", found.end()) + 1 or -1 if other else self._tag_end(found.end())
                if end < 0:
                    break  # no tag ends any more: the rest is text
            self._text(done, found.start())
            pos = done = end
            if not tag:
                continue
            attrs = page[found.end() : end - 1]
            if slash:
                if tag in BLOCK:
                    self.number += 1
                if self.open[tag] > 0:
                    up = self.at
                    while up.tag != tag:
                        up = up.parent
                    self._close(up)
            elif tag == "br":
                if self.nodes and self.nodes[-1][2] == self.number:
                    self.nodes.append((self.at, " ", self.number))
            elif tag in RAW:
                if tag not in self.endless and not attrs.endswith("/"):
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, end)
                    if close is not None:
                        pos = done = close.end()
                    elif tag in ENDLESS:
                        pos = done = len(page)
                    else:
                        self.endless.add(tag)
            else:
                self._start(tag, attrs)
        self._text(done, len(page))


def _without_named(reader: _Reader) -> list[tuple[_Element, str, int]]:
    """The text nodes outside elements that are left out; one that its name alone leaves out stays if it
    holds all of the page's articles, or of a page without any more than half of the text (all of it, if the
    name is that of reader comments)."""
    nodes = [n for n in reader.nodes if not n[0].left_out]
    for e, t, _ in nodes:
        n = len(t.strip())
        e.sum += n
        e.sum_home += n if e.home else 0
    for e in reversed(reader.elements):
        if e.parent is not None:
            e.parent.sum += e.sum
            e.parent.sum_home += e.sum_home
    total, inside = reader.root.sum, reader.root.sum_home
    for e in reader.elements:
        # An article around the element is not in it.
        holds = (not e.home and e.sum_home == inside) if inside else e.sum == total if e.comments else e.sum > 0.5 * total
        e.out = bool(e.parent and e.parent.out) or e.named and not holds
    return [n for n in nodes if not n[0].out]


class _Block:
    """A block: its element, text, and how many letters and digits it has, and has outside links."""

    __slots__ = ("element", "text", "all", "plain", "points")

    def __init__(self, parts: list[tuple[_Element, str]]):
        self.element = next(e for e, t in parts if not t.isspace()).block
        self.text = " ".join("".join(t for _, t in parts).split())
        sizes = [(len(_MARKS.sub("", t)), e.link and not e.head) for e, t in parts]
        self.all = sum(n for n, _ in sizes)
        self.plain = sum(n for n, link in sizes if not link)
        self.points = len(_PUNCTUATION.findall(self.text))


def _scores(blocks: list[_Block]) -> tuple[dict[int, float], dict[int, float], float]:
    """By path: the fused score and the share outside links; and the standard deviation of the raw ratios."""
    count, every, plain, points = (defaultdict(int) for _ in range(4))
    for b in blocks:
        path = b.element.path
        count[path] += 1
        every[path] += b.all
        plain[path] += b.plain
        points[path] += b.points
    ratio = {p: plain[p] / n * (1 + points[p] / n) for p, n in count.items()}
    raw = [ratio[b.element.path] for b in blocks]
    near = [math.exp(-k * k / 2) for k in range(-2, 3)]
    padded = [raw[0]] * 2 + raw + [raw[-1]] * 2
    fused: dict[int, float] = defaultdict(float)
    for i, b in enumerate(blocks):
        smooth = sum(w * x for w, x in zip(near, padded[i : i + 5], strict=True)) / sum(near)
        fused[b.element.path] += math.sqrt(raw[i] * smooth) / count[b.element.path]
    middle = sum(raw) / len(raw)
    spread = math.sqrt(sum((x - middle) ** 2 for x in raw) / len(raw))
    return fused, {p: plain[p] / every[p] if every[p] else 1.0 for p in count}, spread


def _homes(elements: list[_Element], total: int) -> set[_Element]:
    """The elements whose blocks are the text: all article and main elements with content, if they
    hold most of it, or else the lowest container of all content. sum: an element's content."""
    tops: dict[_Element, _Element] = {}
    for e in elements:
        # An article in a main element that has no other content stands for it.
        if e.sum and e.tag in HOMES and e.sum == e.top.sum and (e.top not in tops or tops[e.top].depth < e.depth):
            tops[e.top] = e
    if tops and sum(e.sum for e in tops) >= 0.5 * total:
        return set(tops.values())
    home = max((e for e in elements if e.sum == total), key=lambda e: e.depth)
    while home.parent and home.tag not in SECTIONS and "-" not in home.tag:
        home = home.parent
    # Sections beside it that begin with a heading of its level are the same text's.
    level = home.first.tag if home.first and home.first.head else None
    children: dict[_Element | None, list[_Element]] = defaultdict(list)
    for e in elements if level else ():
        children[e.parent].append(e)
    while level and home.parent and home.parent.tag not in ("html", "body") and any(e.first and e.first.tag == level for e in children[home.parent] if e is not home):
        home = home.parent
    return {home}


def main_text(page: str | None, content: float = CONTENT, plain: float = PLAIN) -> str:
    """The main text of one page: blocks joined by an empty line; "" if there is none."""
    reader = _Reader(page or "")
    parts: dict[int, list[tuple[_Element, str]]] = defaultdict(list)
    for e, t, number in _without_named(reader):
        parts[number].append((e, t))
    blocks = [_Block(own) for _, own in sorted(parts.items()) if any(not t.isspace() for _, t in own)]
    if not blocks:
        return ""
    scores, shares, spread = _scores(blocks)
    limit = min(content * spread, max(scores.values()))
    for e in reader.elements:
        e.sum = 0
    for b in blocks:
        if scores[b.element.path] >= limit:
            b.element.sum += len(b.text)
        b.element.first = b.element.first or b.element
    for e in reversed(reader.elements):
        if e.parent is not None:
            e.parent.sum += e.sum
            e.parent.first = e.first or e.parent.first
    homes = _homes(reader.elements, reader.root.sum)
    for e in reader.elements:
        e.inside = e in homes or bool(e.parent and e.parent.inside)
        # The child of a home that an element is in.
        e.branch = None if e in homes or not e.inside else e.parent.branch or e
    found = [b for b in blocks if b.element.inside]
    bare = homes <= {reader.root} or any(e.tag in ("html", "body") for e in homes)

    def chosen(b: _Block) -> bool:
        # Of a page without a container, the branches that hold content.
        branch = b.element.branch
        return not bare or scores[b.element.path] >= limit or branch is not None and branch.tag in SECTIONS and branch.sum > 0

    # What lies between content belongs to it, and headings right before it.
    at = [k for k, b in enumerate(found) if chosen(b)]
    first, last = at[0], at[-1]
    while first and found[first - 1].element.head:
        first -= 1
    return "\n\n".join(b.text for b in found[first : last + 1] if shares[b.element.path] >= plain)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "_html"):
        texts = [main_text(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page.

    Returns the columns of keep, text and n_chars (its code points). Null and empty
    html, and pages without text, give "" and 0. Unclosed tags, quotes and comments are
    read as browsers do as far as that loses no text. Every row gives one row, repeated
    ones too; an empty table gives an empty one; other columns are not looked at.
    """
    rows = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("_html"), *keep)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_extract, f"{kinds}, text string, n_chars long")
