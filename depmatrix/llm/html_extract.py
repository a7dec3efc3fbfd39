"""Main text of web pages: streaming parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold clustering.

Parser events become lines (blocks of text) that know their tags, their container and whether they stand in a part that is never content
(menus, footers, adverts, forms, comments). The logarithms of the lines' text-to-tag ratios are smoothed and split in two clusters, that of lines without text (its
centre stays at zero) and that of lines with text, so that a short paragraph beside a long one is text still. A line is content if it is in the upper cluster
by its smoothed ratio and by its own (smoothing lifts what stands next to text); a container with such a line is a content region,
and all its lines are kept, short ones too.

An <article>, <main> or role=main gives a bonus, no more: where one has a content region, its other containers are regions too if their mean
smoothed ratio is half the threshold, or if they are prose by their own ratio, or if they are an <article>'s own lines (its title); so is its h1. One without a
content region (a teaser) gets nothing.

Menus, footers, scripts and the like are left out by element. What only a name (class, id, role) or a form speaks against is left out too, unless nothing else on the
page is text: where the lines outside such parts have hardly any text in the upper cluster, the part with most of it is taken for a wrapper and judged by its own lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start and end a block.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
NEVER = frozenset("script style noscript template svg math iframe object nav footer aside menu button select option textarea head title dialog audio video canvas".split())
#: Words of class, id or role that mark such parts wherever they stand in a name.
SIGNS = frozenset("advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus foot footer imprint menu modal nav navbar navigation newsletter pager pagination popup promo promoted respond sidebar sponsor sponsored subscribe toolbar".split())
#: Words that do so alone or beside words of place only (ad-slot, site-header, related-posts, but not article-header, related-work).
WEAK = frozenset("ad ads banner copyright disclaimer gdpr head header legal masthead navigator notice notices related replies reply search share sharing skip social widget".split())
#: Words of place.
PLACES = frozenset("area bar big block bottom box btn button buttons center col column container desktop fixed global group head icons inner item items left link links list main mobile module outer page panel post posts right row section site slot small sticky stories strip thread tools top unit wrap wrapper".split())
_COMMENT = frozenset("comment comments reply replies respond disqus".split())
_MAIN = frozenset(("article", "main"))
_HOLDERS = frozenset("article main section div td body html".split())
#: Elements that may stand in a head; any other one ends it, as its end tag may be left out.
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: In a named element with a content region: part of the threshold's ratio that a container's mean must reach, or characters a tag.
_BONUS, _PROSE = 0.5, 40.0
#: Characters of text outside the named parts that speak for leaving these out, and how many times as many a named part must have to be a wrapper.
_SPARE, _WRAPS = 140, 4
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def signed(names: str, signs: frozenset[str] = SIGNS, weak: frozenset[str] = WEAK) -> bool:
    """Whether a class, id or role names a part that is never content; names are split at spaces, then into words."""
    for name in names.split():
        words = [w.lower() for w in _PART.findall(name)]
        if any(w in signs for w in words) or any(w in weak for w in words) and all(w in weak or w in PLACES for w in words):
            return True
    return False


class _Lines(HTMLParser):
    """Blocks of text with their tags. Each event costs a bounded time or takes away what it looks at, so a page costs time in proportion to its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, container, outermost article or main (0: none), in an h1
        self._stack: list[tuple[str, int, int, int]] = []  # tag, part (below zero: never content), container, main
        self._places: dict[str, list[int]] = {}  # tag: where it stands in the stack
        self._blocks: list[int] = []  # where blocks stand
        self._text: list[str] = []
        self._tags = self._made = 0
        self._heading = False
        self.articles: set[int] = set()  # containers that are an outermost article
        self._parts: list[tuple[int, str]] = [(0, "")]  # parts that a name or a form speaks against: the part around, tag and names; 0 is the page
        self._part_of: list[int] = []  # of each line

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            _, part, holder, main = self._stack[-1] if self._stack else ("", 0, 0, 0)
            self.lines.append((text, self._tags, holder, main, bool(self._places.get("h1"))))
            self._part_of.append(part)
            self._tags = 0

    def _never(self, tag: str, a: dict[str, str], main: int) -> bool:
        """Whether an element is never content."""
        if tag in NEVER or tag == "header" and not main:
            return True
        return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")

    def _named(self, tag: str, a: dict[str, str], main: int) -> bool:
        """Whether a name, or being a form, speaks against an element."""
        if tag in ("body", "html"):
            return False
        if tag == "form":
            return True
        names = " ".join(a.get(k, "") for k in ("class", "id", "role"))
        if tag in _MAIN:  # an article with a telling name is one inside another; a comment is one in any case
            return signed(names, SIGNS if main else _COMMENT, WEAK if main else frozenset())
        return signed(names)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._places.get("head") and tag not in _IN_HEAD:
            self._flush()
            self._close("head")
        if tag in BLOCKS:
            self._flush()
            self._close("p")  # a block ends an open paragraph
        self._tags += 1
        if tag in VOID:
            if tag == "br":
                self._text.append("\n")
            return
        _, part, holder, main = self._stack[-1] if self._stack else ("", 0, 0, 0)
        a = {k: v or "" for k, v in attrs}
        if part >= 0 and self._never(tag, a, main):
            part = -1
        elif part >= 0 and self._named(tag, a, main):
            if tag in BLOCKS:
                self._parts.append((part, f"{tag} {a.get('class', '')} {a.get('role', '')}"))
                part = len(self._parts) - 1
            else:
                part = -1  # no wrapper
        if tag in _HOLDERS or a.get("role") == "main":
            self._made += 1
            holder = self._made
        if not main and (tag in _MAIN or a.get("role") == "main"):
            main = holder
            if tag == "article":
                self.articles.add(holder)
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCKS:
            self._blocks.append(len(self._stack))
        self._stack.append((tag, part, holder, main))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe"):
            self._close(tag)

    def _close(self, tag: str) -> None:
        """Ends the innermost open element of that name, and what stands in it; a paragraph only if no block stands in it."""
        open_ = self._places.get(tag)
        if not open_ or tag == "p" and self._blocks[-1] > open_[-1]:
            return
        for _ in range(len(self._stack) - open_[-1]):
            self._places[self._stack.pop()[0]].pop()
            if self._blocks and self._blocks[-1] == len(self._stack):
                self._blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not (self._stack and self._stack[-1][1] < 0):
            self._text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What starts with <![ is a comment up to the next >, whatever it is."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1

    def unknown_decl(self, data: str) -> None:
        pass

    def close(self) -> None:
        super().close()
        self._flush()
        self._without_parts()

    def _without_parts(self) -> None:
        """Leaves out the lines of parts that a name speaks against, but for wrappers; their tags go to the next line that stays."""
        if len(self._parts) == 1 or not self.lines:
            return
        own = [math.log1p(len(x[0]) / max(1, x[1])) for x in self.lines]
        least = threshold(own)
        direct, named = [0] * len(self._parts), set()  # text in the upper cluster; parts with a sentence in an article or main
        for x, o, part in zip(self.lines, own, self._part_of, strict=True):
            if o >= least:
                direct[part] += len(x[0])
            if x[3] and not x[4] and x[0][-1] in ".!?\u2026\u3002":
                named.add(part)
        whole, inside = direct.copy(), [[] for _ in self._parts]
        for part in range(len(self._parts) - 1, 0, -1):  # a part stands behind the one around it
            whole[self._parts[part][0]] += whole[part]
            inside[self._parts[part][0]].append(part)
        stay, todo = {0}, [0]
        while todo:
            part = todo.pop()
            largest = max(inside[part], key=lambda p: (whole[p], -p), default=0)
            if largest and direct[part] < _SPARE and part not in named and whole[largest] > _WRAPS * direct[part]:
                alike = [p for p in inside[part] if self._parts[p][1] == self._parts[largest][1]]
                stay.update(alike)
                todo.extend(alike)
        lines, tags = [], 0
        for x, part in zip(self.lines, self._part_of, strict=True):
            tags += x[1]
            if part in stay:
                lines.append((x[0], tags, *x[2:]))
                tags = 0
        self.lines = lines


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing, at the ends over what is there."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[low - i + reach : high - i + reach]
        out.append(sum(a * b for a, b in zip(values[low:high], w, strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Where two clusters of the values part, in one dimension; the lower one's mean is held at zero. Values all alike are one cluster, above."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low
    while True:
        cut = high / 2
        above = [v for v in values if v >= cut]
        new = sum(above) / len(above)
        if abs(new - high) < 1e-9:
            return cut
        high = new


def content(lines: list[tuple[str, int, int, int, bool]], articles: set[int]) -> list[int]:
    """The lines that are kept. lines: text, tags, container, named element or 0, whether it is in an h1."""
    if not lines:
        return []
    own = [math.log1p(len(x[0]) / max(1, x[1])) for x in lines]
    ratio = smoothed(own)
    cut, least = threshold(ratio), threshold(own)
    part = lambda share: math.log1p(share * math.expm1(cut))  # noqa: E731  a share of the threshold's ratio
    regions = {x[2] for x, r, o in zip(lines, ratio, own, strict=True) if r >= cut and o >= least}
    if not regions:  # no line is above by both: the smoothed clusters alone decide
        regions = {x[2] for x, r in zip(lines, ratio, strict=True) if r >= cut}
    seeded = {x[3] for x in lines if x[3] and x[2] in regions}
    held: dict[int, list[int]] = {}
    for k, x in enumerate(lines):
        if x[3] in seeded:
            held.setdefault(x[2], []).append(k)
    for holder, places in held.items():
        size, tags, mean = (
            sum(len(lines[k][0]) for k in places),
            sum(lines[k][1] for k in places),
            sum(ratio[k] for k in places) / len(places),
        )
        if mean >= part(_BONUS) or size >= _PROSE * max(1, tags) or holder in articles:
            regions.add(holder)
    return [k for k, x in enumerate(lines) if x[2] in regions or x[4] and x[3] in seeded]


def extract(html: str | None) -> str:
    """Blocks of the content regions, joined by an empty line. Null or empty: an empty text."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return "\n\n".join(parser.lines[k][0] for k in content(parser.lines, parser.articles))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages (page_id, url, html).

    Null or empty html: an empty text and 0. Repeated rows come out alike. Very long pages take time in proportion. Empty table: no rows. Extra columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
