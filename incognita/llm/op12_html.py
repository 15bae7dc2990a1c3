"""HTML extraction: text-to-tag ratios of lines, smoothed and clustered, select the content.

The standard library's parser streams its events once. A line ends wherever a block starts or
ends; it has its text, the number of its tags and the elements around it. Elements that are no
content by their kind (menus, forms, scripts, ...) or by what they are called (adverts, comments,
...) take their lines out. The ratios of the others are smoothed by a Gaussian kernel; lines above
the threshold form the content cluster, and the section that holds the cluster is the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from incognita.llm.common import column, free_name, small_batches, table

SIGMA = 1.5  # standard deviation of the kernel, in lines
LEVEL = 1.0  # threshold, in means of the smoothed ratios
SHARE = 0.8  # part of the cluster's text that a section without a telling name must hold

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp
    small span strike strong sub sup time tt u var""".split()
)
SECTIONS = frozenset("html body div section article main td table tbody tr center blockquote".split())
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
CLOSES = {  # an open element that the start of another one ends, up to the nearest of its bounds
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# never part of an article
HARD_TAGS = frozenset(
    """head title script style noscript template nav aside menu dialog select textarea button datalist iframe object
    canvas svg math audio video map noframes""".split()
)
SOFT_TAGS = frozenset(["form", "header", "footer"])  # not if the article itself lies in there
HARD_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot promo promoted sponsor sponsored comment comments
    commentlist disqus respond replies cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs sidebar
    widget widgets rail related recommended recommendations newsletter subscribe signup login share sharing social
    pagination pager skip disclaimer""".split()
)
SOFT_WORDS = frozenset("notice notices alert banner menu footer header masthead search toolbar topbar popup modal overlay form".split())
ROLES = {"navigation": 2, "menu": 2, "menubar": 2, "complementary": 2, "search": 2, "alert": 2, "dialog": 2, "alertdialog": 2, "banner": 1, "contentinfo": 1, "form": 1}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@lru_cache(maxsize=4096)
def _called(names: str) -> int:
    """2: names of what is never content, 1: of what is none unless it holds the article, else 0."""
    mark = 0
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] in ("with", "has", "no", "without"):
            continue
        if not HARD_WORDS.isdisjoint(words):
            return 2
        if not SOFT_WORDS.isdisjoint(words):
            mark = 1
    return mark


class Page(HTMLParser):
    """Lines and elements of one page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = ["html"]  # of all elements, by number
        self.parents = [0]
        self.marks = [0]
        self.open = [0]  # numbers of the open elements
        self.places: dict[str, list[int]] = {"html": [0]}  # of open elements of a tag in ``open``
        self.blocks = [0]  # places of open blocks
        self.lines: list[tuple[list[tuple[int, str]], int]] = []  # parts of text with their element, tags
        self.parts: list[tuple[int, str]] = []
        self.n_tags = 0

    def _end_line(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.n_tags))
            self.parts, self.n_tags = [], 0

    def _close(self, place: int) -> None:
        """Close the elements from this place on."""
        while len(self.open) > place:
            self.places[self.tags[self.open.pop()]].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in HARD_TAGS:
            return 2
        own = {k: v or "" for k, v in reversed(attrs)}
        mark = 1 if tag in SOFT_TAGS else 0
        if tag == "header" and self._last({"article", "main"}) >= 0:
            mark = 0  # the article's own heading
        if tag == "article" and self.places.get("article"):
            return 2  # an article in an article is a reader's
        if tag in ("html", "body"):
            return 0
        if "hidden" in own or own.get("aria-hidden") == "true" or _UNSEEN.search(own.get("style", "")):
            return 2
        mark = max(mark, ROLES.get(own.get("role", "").lower(), 0))
        named = _called(f"{own.get('class', '')} {own.get('id', '')}")
        return max(mark, min(named, 1) if tag == "main" else named)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if self.places.get("head") and tag not in IN_HEAD:
            self._close(self.places["head"][-1])
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif self.parts and tag == "br":
                self.parts.append((self.open[-1], " "))
            return
        if tag == "html" or (tag == "body" and self.places.get("body")):
            return
        if tag not in INLINE:
            self._end_line()
            if self.places.get("p"):
                self._close(self.places["p"][-1])
            ends, bounds = CLOSES.get(tag, ((), ()))
            place = self._last(ends) if ends else -1
            if place > (self._last(bounds) if bounds else -1):
                self._close(place)
            self.blocks.append(len(self.open))
        self.marks.append(self._mark(tag, attrs))
        self.places.setdefault(tag, []).append(len(self.open))
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.cdata_elem is not None:
            self.clear_cdata_mode()
        if tag not in VOID and tag in ("script", "svg", "math", "iframe", "canvas"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag not in INLINE:
            self._end_line()
        if self.places.get(tag) and tag not in ("html", "body"):
            place = self.places[tag][-1]
            if tag not in INLINE or place > self.blocks[-1]:
                self._close(place)

    def handle_data(self, data: str) -> None:
        if self.tags[self.open[-1]] == "head" and not data.isspace():
            self._close(self.places["head"][-1])
        if self.parts or not data.isspace():
            self.parts.append((self.open[-1], data))

    def read(self, html: str) -> None:
        """The whole page. What stands open at its end (a tag without >, a comment, a script) is markup."""
        self.feed(html)
        rest = self.rawdata
        if self.cdata_elem is None and not re.match(r"<[A-Za-z/!?]", rest):
            self.close()
        self._end_line()


def _visible(page: Page) -> np.ndarray:
    """For each element, whether neither it nor one around it is marked."""
    n = len(page.tags)
    holds = [False] * n  # an article
    for i in range(n - 1, 0, -1):
        if page.marks[i] < 2 and (holds[i] or page.tags[i] in ("article", "main")):
            holds[page.parents[i]] = True
    seen = np.ones(n, bool)
    for i in range(1, n):
        seen[i] = seen[page.parents[i]] and (page.marks[i] == 0 or (page.marks[i] == 1 and holds[i]))
    return seen


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian kernel of three deviations to each side; ends count themselves."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_lines(ratios: np.ndarray, sigma: float = SIGMA, level: float = LEVEL) -> np.ndarray:
    """Which lines belong to the content cluster: smoothed ratios at the threshold or above."""
    if not len(ratios):
        return np.zeros(0, bool)
    smooth = smoothed(ratios, sigma)
    return (smooth >= min(level * smooth.mean(), smooth.max())) & (ratios > 0)


def _section(page: Page, owner: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> int:
    """The element that is the article: an article or main element with half of the cluster's text,
    else the least section that holds nearly all of it and most of its lines."""
    n = len(page.tags)
    chars, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(chars, owner, weight)
    np.add.at(lines, owner, weight > 0)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        lines[page.parents[i]] += lines[i]
        if seen[i]:
            children[page.parents[i]].append(i)
    for kind in ("article", "main"):
        named = [i for i in range(1, n) if page.tags[i] == kind and seen[i]]
        best = max(named, key=lambda i: (chars[i], -i), default=0)
        if best and chars[best] * 2 >= chars[0]:
            return best
    at = best = 0
    while children[at]:
        child = max(children[at], key=lambda i: (chars[i], -i))
        if chars[child] < SHARE * chars[0] or lines[child] * 2 <= lines[0]:
            break
        at = child
        if page.tags[at] in SECTIONS:
            best = at
    return best


def main_blocks(html: str | None, sigma: float = SIGMA, level: float = LEVEL) -> list[str]:
    """The blocks of the article in page order, white space as single blanks; none may be empty."""
    page = Page()
    page.read(html or "")
    seen = _visible(page)
    texts, tags, owner = [], [], []
    for parts, n_tags in page.lines:
        text = " ".join("".join(t for i, t in parts if seen[i]).split())
        if text:
            texts.append(text)
            tags.append(max(n_tags, 1))
            owner.append(next(i for i, t in parts if seen[i] and not t.isspace()))
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    # ratios range over four orders of magnitude, and one long paragraph is no reason to drop short ones
    ratios = np.log1p(sizes / np.array(tags))
    weight = np.where(content_lines(ratios, sigma, level), sizes, 0)
    owners = np.array(owner)
    chosen = _section(page, owners, weight, seen)
    inside = np.zeros(len(page.tags), bool)
    inside[chosen] = True
    for i in range(chosen + 1, len(page.tags)):
        inside[i] = inside[page.parents[i]]
    return [t for t, i in zip(texts, owner, strict=True) if inside[i]]


def extract(pages: DataFrame, html: str = "html", sigma: float = SIGMA, level: float = LEVEL) -> DataFrame:
    """``pages`` with the main text of each page (``text``) and its code points (``n_chars``).

    Blocks are joined by line breaks. NULL and empty pages, and pages without an article, give the
    empty string; plain text without tags is a block; a page cut anywhere gives the text up to there.
    White space is what Python takes for it, no-break blanks included. Repeated rows give repeated
    rows, an empty table none. Columns of the frame named as these two are replaced.
    """
    small_batches(pages.sparkSession)
    own = {"text": T.StringType(), "n_chars": T.LongType()}
    kept = [c for c in pages.columns if c.lower() not in own]
    schema = T.StructType([pages.schema[c] for c in kept])
    for name, kind in own.items():
        schema = schema.add(name, kind)
    frame = pages.select(*[column(c) for c in kept], column(html).alias(free_name(pages, "source_html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(cell.as_py(), sigma, level)) for cell in batch.column(len(kept))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), sizes], names=[*kept, *own])

    return frame.mapInArrow(run, schema)


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. NULL and empty pages give empty texts; an empty table gives no rows."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
