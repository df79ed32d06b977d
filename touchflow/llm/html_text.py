"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams a page's events into lines, one per text block, each with
its text, the number of tags around it and its place in the page. Blocks of menus, headers, footers,
sidebars, notices, adverts, forms and comments are set aside by their element, role, class or id, where a
class or id counts as a whole name or a known compound, and never as the id of a heading or paragraph.
What is set aside by such a name, or as a form, comes back if the page's content is in it: nine tenths
of the dense text, or half of it with an article, main or h1; comments never do. The text-to-tag ratios of the lines are smoothed with a Gaussian and split into two clusters,
which also decide on blocks of an article whose name is in doubt. The content region is the innermost article or main,
or else the smallest container, that holds all lines of the content cluster but lists of links; all its
lines are kept, headings and short paragraphs included, and so are an article's sibling articles and a
heading right before it.

Edge cases: null and empty pages have the text ""; broken markup is read as the parser reads it;
pages of markup only have the text ""; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset(
    "head script style noscript template title iframe object embed svg math canvas audio video "
    "button select option optgroup textarea input datalist label fieldset legend nav footer "
    "aside menu dialog search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar tablist".split())
CLOSES_P = BLOCK - {"body", "html", "head", "title", "caption", "legend", "summary", "tbody", "td",
                    "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
#: Words of a class or id that mark a block which is not part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense adslot "
    "breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus "
    "footer footnav gdpr menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promotion related recommended share sharing "
    "sidebar sidebars sidenav sideblock signup social sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split())
#: Words that mark the head of a page, but may as well mark an article's own heading inside it.
HEAD_MARKS = frozenset("banner header masthead".split())
#: Words that go with these in the name of a page's head.
HEAD_WITH = frozenset("area bar block box container global inner left main page right site top wrap "
                      "wrapper".split())
#: Words that go with a mark in a name, as in ``related-posts``.
WITH = frozenset(
    "area bar block body bottom box button buttons col column container content count fixed floating "
    "form global google header inline inner item items icons left link links list main message mobile "
    "module outer page panel popup post posts articles primary reader readers right row secondary section "
    "side site slot sticky text thread title top unit user users wide wrap wrapper".split())
#: Marks that may as well name a paragraph, heading or section of an article.
DOUBTFUL = frozenset(
    "consent cookie cookies menu notice notices notification overlay promotion related "
    "recommended share sharing social sponsor subscribe subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

SIGMA = 1.0
#: Elements whose start ends an open element of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
          "th": {"table"}, "option": {"select"}}


#: How an element is set aside: not at all, in doubt, by name or as a form, and for good.
KEPT, DOUBT, NAMED, GONE = range(4)


def _set_aside(tag: str, attributes: list[tuple[str, str | None]], inside: bool) -> int:
    """How an element is set aside by its attributes, ``inside`` an article or main."""
    text, found = tag == "p" or tag in HEADINGS, KEPT
    for name, value in attributes:
        if name == "hidden" or value and (
                name == "role" and value.lower().strip() in ROLES
                or name == "aria-hidden" and value.lower() == "true"):
            return GONE
        if name not in ("class", "id") or not value or name == "id" and text:
            continue
        for one in value.lower().split():
            words = {w for w in _WORD.findall(one) if not w[0].isdigit()}
            if words & MARKS and words <= MARKS | WITH:
                if words & COMMENTS:
                    return GONE
                doubt = inside and words <= DOUBTFUL and (text or name == "id" and tag == "section")
                found = max(found, DOUBT if doubt else NAMED)
            elif not inside and words & HEAD_MARKS and words <= HEAD_MARKS | HEAD_WITH:
                found = NAMED
    return found


class _Lines(HTMLParser):
    """Collects (text, tags, containers, mostly links) of each block outside set-aside elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.open: list[tuple[str, int, bool]] = []  # name, number, hides what is inside
        self.hidden = 0
        self.number = 0
        self.kind: dict[int, str] = {}
        self.words: list[str] = []
        self.tags = 0
        self.doubtful: set[int] = set()
        self.named: set[int] = set()
        self.links: set[int] = set()  # open elements
        self.linked = 0  # characters of the line in links

    def _end_line(self) -> None:
        if self.words:
            text = _SPACE.sub(" ", "".join(self.words)).strip()
            self.words = []
            if text:
                path = tuple(n for name, n, _ in self.open if name in BLOCK or n in self.named)
                self.lines.append((text, self.tags, path, 2 * self.linked > len(text)))
                self.tags = 0
            self.linked = 0

    def _close(self, position: int) -> None:
        """Ends the open elements from this position on."""
        if any(name in BLOCK for name, _, _ in self.open[position:]):
            self._end_line()
        for _, number, hides in self.open[position:]:
            self.hidden -= hides
            self.links.discard(number)
        del self.open[position:]

    def _close_last(self, names: set[str], limits: set[str]) -> None:
        for position in range(len(self.open) - 1, -1, -1):
            name = self.open[position][0]
            if name in names:
                self._close(position)
                return
            if name in limits:
                return

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK and self.open and self.open[0][0] == "head" or tag == "body":
            self._close_last({"head"}, set())
        if tag in CLOSES_P:
            self._close_last({"p"}, BLOCK - {"p"})
        if tag in SIBLINGS:
            self._close_last(SIBLINGS[tag], LIMITS[tag])
        if tag in BLOCK:
            self._end_line()
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        inside = any(name in ("article", "main") for name, _, _ in self.open)
        aside = GONE if tag in HIDDEN or tag == "header" and not inside else \
            NAMED if tag == "form" else KEPT
        if aside < GONE and attributes and tag not in ("html", "body", "main", "article"):
            aside = max(aside, _set_aside(tag, attributes, inside))
        self.number += 1
        if aside == DOUBT:
            self.doubtful.add(self.number)
        elif aside == NAMED:
            self.named.add(self.number)
        hides = aside == GONE
        if tag == "a" and any(name == "href" for name, _ in attributes):
            self.links.add(self.number)
        self.kind[self.number] = tag
        self.open.append((tag, self.number, hides))
        self.hidden += hides

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attributes)
        else:  # a slash has no meaning in HTML outside void elements
            self.handle_starttag(tag, attributes)
            if tag in ("svg", "math", "path", "g", "use"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for position in range(len(self.open) - 1, -1, -1):
            name = self.open[position][0]
            if name == tag:
                self._close(position)
                return
            if name in BLOCK and tag not in BLOCK:
                return  # an inline element that is open outside of this block

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, tuple[int, ...], bool]]:
        self.close()
        self._close(0)
        self._end_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean of the neighbours; weights at the ends are scaled to sum to one."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    result = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach:high - i + reach]
        result.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return result


def threshold(values: list[float]) -> float:
    """The middle between the means of two clusters of the values."""
    low, high = min(values), max(values)
    while low < high:
        middle = (low + high) / 2
        below = [v for v in values if v <= middle]
        above = [v for v in values if v > middle]
        if not below or not above:
            break
        means = sum(below) / len(below), sum(above) / len(above)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2 if low < high else low


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one per line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    if html.rfind("<!--") > html.rfind("-->"):  # the parser takes an open comment for text
        parser.feed("-->")
    lines = parser.finish()
    if not lines:
        return ""
    for containers, drops in ((parser.named, _without_content), (parser.doubtful, _mostly_thin)):
        if containers:
            dropped = drops(parser, lines, containers)
            lines = [line for line in lines if dropped.isdisjoint(line[2])]
            if not lines:
                return ""
    content = _content(lines)
    regions = _regions(parser, lines, sorted(content))
    inside = [not regions or not regions.isdisjoint(path) for _, _, path, _ in lines]
    if regions:
        _with_heading(parser, lines, inside)
    return "\n".join(line[0] for line, keep in zip(lines, inside) if keep)


def _held(lines: list[tuple], containers: set[int]) -> tuple[Counter, Counter, int]:
    """Characters and dense characters in each container, and dense ones of the page."""
    content = _content(lines)
    held, dense, total = Counter(), Counter(), 0
    for i, (text, _, path, _) in enumerate(lines):
        total += len(text) * (i in content)
        for container in containers.intersection(path):
            held[container] += len(text)
            dense[container] += len(text) * (i in content)
    return held, dense, total


def _without_content(parser: _Lines, lines: list[tuple], containers: set[int]) -> set[int]:
    """Containers set aside by name that do not hold the page's content."""
    held, dense, total = _held(lines, containers)
    head = {c for _, _, path, _ in lines
            if any(parser.kind[n] in ("article", "main", "h1") for n in path)
            for c in containers.intersection(path[:1 + max(
                i for i, n in enumerate(path) if parser.kind[n] in ("article", "main", "h1"))])}
    return {c for c in held if 10 * dense[c] < 9 * total and not (c in head and 2 * dense[c] > total)}


def _mostly_thin(parser: _Lines, lines: list[tuple], containers: set[int]) -> set[int]:
    held, dense, _ = _held(lines, containers)
    return {c for c in held if 2 * dense[c] < held[c]}


def _content(lines: list[tuple]) -> set[int]:
    """Lines of the content cluster that are not mostly links; with them if there are no others."""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _, _ in lines])
    least = threshold(ratios)
    cluster = {i for i, ratio in enumerate(ratios) if ratio >= least}
    return {i for i in cluster if not lines[i][3]} or cluster


def _innermost(lines: list[tuple], content: list[int], allowed) -> int | None:
    """The innermost allowed container of all these lines."""
    common = set(lines[content[0]][2]).intersection(*(lines[i][2] for i in content[1:]))
    return max(filter(allowed, common), default=None)


def _regions(parser: _Lines, lines: list[tuple], content: list[int]) -> set[int]:
    """Containers that hold the article; none if it is the whole page."""
    def named(container: int) -> bool:
        return parser.kind[container] in ("article", "main")

    outer: dict[int, list[int]] = {}
    for i in content:
        if (top := next(filter(named, lines[i][2]), None)) is not None:
            outer.setdefault(top, []).append(i)
    if 2 * sum(len(lines[i][0]) for own in outer.values() for i in own) > sum(
            len(lines[i][0]) for i in content):
        return _siblings(parser, lines, {_innermost(lines, own, named) for own in outer.values()})
    several = Counter(container for _, _, path, _ in lines for container in path)
    region = _innermost(lines, content, lambda c: several[c] > 1)
    return set() if region is None else {region}


def _siblings(parser: _Lines, lines: list[tuple], regions: set[int]) -> set[int]:
    """The regions, and the articles beside one of them that are not mostly links."""
    parent, held, linked = {}, Counter(), Counter()
    for text, _, path, links in lines:
        for above, container in zip((0, *path), path):
            if parser.kind[container] == "article":
                parent[container] = above
                held[container] += len(text)
                linked[container] += len(text) * links
    beside = {parent[c] for c in regions if c in parent}
    return regions | {c for c, above in parent.items() if above in beside and 2 * linked[c] <= held[c]}


def _with_heading(parser: _Lines, lines: list[tuple], inside: list[bool]) -> None:
    """Also keeps the headings right before the article in its parent, and what is between."""
    first = inside.index(True)
    shared = set(lines[first][2])
    begin, at = first, first - 1
    while at >= 0 and not lines[at][3] and any(
            parser.kind[c] not in ("html", "body") for c in shared.intersection(lines[at][2])):
        if any(parser.kind[c] in HEADINGS for c in lines[at][2]):
            begin = at
        at -= 1
    inside[begin:first] = [True] * (first - begin)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch["html"]]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Page id, url, main text and its number of code points; no shuffle."""
    ready = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                         F.col("html").cast("string"))
    return ready.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars long")
