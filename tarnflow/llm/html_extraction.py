"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one for each stretch of text between
block tags. A line's score is its characters over its tags, times the weight of the evidence around it: elements
for articles raise it, and names of adverts, comments, menus and the like lower it. Smoothed scores above a
threshold mark clusters of content. The summed scores of the clusters choose the region: the articles, the main element, or
the regions that hold most of them. In it every line stays but those whose names speak against them and whose
score doesn't outweigh that. Only what can't be text of the page at all (scripts, styles, forms, navigation
elements, hidden parts) scores nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tarnflow.llm.storage import bound_batches
from tarnflow.llm.textbytes import pieces

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NOISE = set("head title script style noscript template nav menu header footer aside form button select textarea datalist dialog iframe object svg canvas audio video math applet frameset noframes".split())
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status", "tablist"}
_NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices notification popup modal overlay subscribe subscription newsletter signup login comment comments commentlist disqus respond reply replies discussion toolbar pagination pager skip outbrain taboola copyright hidden adsbygoogle topbar leaderboard rail paywall teaser teasers".split()
)
#: What a start tag ends if it is open: an element can't stand inside another of its kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Where the search for such an element stops.
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "body": {"html"}}
_KEEP = {"html", "body", "main", "article"}
#: Whole class names that make even an article noise.
_NOT_ARTICLE = {"ad", "advert", "advertisement", "comment", "comments", "comment-item", "comment-body", "promo", "related", "reply", "sponsored", "teaser"}
_REGIONS = {"article", "main", "section", "div", "td", "body"}
#: Parts of names that speak for content: beside them a name of ``_NOISE_NAMES`` is no more than a hint.
_TEXT_NAMES = {"article", "articles", "blog", "body", "content", "entry", "main", "page", "post", "story", "text"}
#: Names that nothing speaks for.
_SURE_NAMES = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "cookie", "cookies", "consent", "gdpr", "hidden"}
#: Weights: a name of ``_NOISE_NAMES``, such a name with one of ``_TEXT_NAMES``, lines of a main element and of an article.
_NAMED, _HINTED, _MAIN, _ARTICLE = 0.02, 0.3, 1.5, 2.0
_SPLIT = re.compile(r"[^a-z0-9]+")


def _weigh(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """Weight of the lines in an element by its names; 0 where its kind or attributes rule out text of the page."""
    if _is_noise(tag, attrs):
        return 0.0
    weight = 1.0
    for name, value in attrs:
        if name not in ("class", "id") or not value:
            continue
        if tag == "article":
            if name == "class" and not _NOT_ARTICLE.isdisjoint(value.lower().split()):
                return _NAMED
        elif tag not in _KEEP:
            for whole in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                parts = {x.rstrip("0123456789") for x in _SPLIT.split(whole)}
                if not _NOISE_NAMES.isdisjoint(parts):
                    sure = _TEXT_NAMES.isdisjoint(parts) or not _SURE_NAMES.isdisjoint(parts)
                    weight = min(weight, _NAMED if sure else _HINTED)
    return weight


def _is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in _NOISE:
        return True
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif name == "role":
            if value.strip().lower() in _NOISE_ROLES:
                return True
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
    return False


class Lines(HTMLParser):
    """Lines of a page: ``text``, ``tags`` before and in it, ``weight``, ``region`` and ``article`` numbers (0: none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, float, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.open: list[tuple[str, float, int, int]] = []  # tag, weight, region, article
        self.count = 0
        self.kinds: dict[int, str] = {}

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                _, weight, region, article = self.open[-1] if self.open else ("", 1.0, 0, 0)
                self.lines.append((text, self.tags, weight, region, article))
                self.tags = 0

    def _close(self, at: int) -> None:
        around = self.open[at - 1][1] if at else 1.0
        if any(tag in _BLOCK or weight < around for tag, weight, _, _ in self.open[at:]):
            self.flush()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag in _BLOCK:
                self.flush()
            return
        if tag in _BLOCK and tag not in _ENDS:  # a block ends an open paragraph
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self._close(at)
                    break
                if self.open[at][0] in _BLOCK:
                    break
        elif tag in _ENDS:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in _ENDS[tag]:
                    self._close(at)
                    break
                if self.open[at][0] in _SCOPES[tag]:
                    break
        _, weight, region, article = self.open[-1] if self.open else ("", 1.0, 0, 0)
        own = _weigh(tag, attrs)
        if tag in _BLOCK or own == 0 or own == _NAMED:
            self.flush()
        elif own < 1:  # a hint about words within a line
            own = 1.0
        inner = min(weight, weight * own) if own else 0.0
        if tag in _REGIONS and inner:
            self.count += 1
            region = self.count
            if tag in ("article", "main") and own == 1 and self.kinds.get(article) != "article" and (tag == "article" or not article):
                article = self.count
                self.kinds[article] = tag
        self.open.append((tag, inner, region, article))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "path"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if tag not in _BLOCK and self.open[at][0] in ("td", "th", "article", "section", "body"):
                break  # a stray inline end tag ends nothing outside
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        self.parts.append(data)


def smooth(scores: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and made to sum to one."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(np.ones(len(scores)), kernel)[reach : reach + len(scores)]
    return np.convolve(scores, kernel)[reach : reach + len(scores)] / whole


def line_scores(page: Lines, sigma: float) -> np.ndarray:
    """Smoothed text-to-tag ratios of the lines, weighted by what stands around them."""
    raised = {"main": _MAIN, "article": _ARTICLE}
    weight = np.array([x[2] * raised.get(page.kinds.get(x[4], ""), 1.0) for x in page.lines])
    scores = weight * [len(x[0]) / max(1, x[1]) for x in page.lines]
    return np.where(weight > 0, smooth(scores, sigma) * np.minimum(1, weight), 0.0)


def choose_lines(page: Lines, scores: np.ndarray, strength: float) -> np.ndarray:
    """Places of the lines of the content region, by their scores."""
    weight = np.array([x[2] for x in page.lines])
    region, article = (np.array([x[k] for x in page.lines]) for k in (3, 4))
    content = (scores > 0) & (scores >= strength * scores.std())
    mass = np.where(content, scores * [len(x[0]) for x in page.lines], 0)
    if not mass.any():
        return np.zeros(0, int)
    stays = (weight == 1) | content
    inside = np.array([page.kinds.get(k) == "article" for k in article])
    if mass[inside].sum() > 0.5 * mass.sum():  # an article within a main element is the closer one
        stays &= inside
    elif mass[article > 0].sum() > 0.5 * mass.sum():
        stays &= article > 0
    else:
        # Regions that hold a good part of the mass of the best one, and what stands between their first and last content line.
        by = np.bincount(region, mass)
        at = np.flatnonzero(content & (by[region] >= 0.2 * by.max()))
        stays[: at[0]] &= region[: at[0]] == region[at[0]]
        stays[at[-1] + 1 :] &= region[at[-1] + 1 :] == region[at[-1]]
    return np.flatnonzero(stays)


def main_text(html: str | None, sigma: float = 1.0, strength: float = 0.5, score=line_scores) -> str:
    """The lines of the content region, joined by line feeds."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    return "\n".join(page.lines[k][0] for k in choose_lines(page, score(page, sigma), strength))


def _extract(row_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(row_type), pa.array(texts, pa.string())], ["row", "text"])

    return run


def extract_main_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Each page as ``row`` (struct of its other columns) with ``text``, its main text.

    Character references are decoded, white space within a block becomes one space, blocks are trimmed and
    joined in page order by one line feed; empty blocks vanish. A null or empty page, or one without content,
    gives an empty text. Repeated rows each give a row; an empty table gives none. Pages are parsed whole, one
    at a time, so memory follows the longest page.
    """
    bound_batches(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    packed = pages.select(F.struct(*others).alias("row"), F.col(html).cast("string").alias("html"))
    row_type = packed.select("row").limit(0).toArrow().schema.field("row").type
    return packed.mapInArrow(_extract(row_type), StructType([packed.schema["row"], StructField("text", StringType())]))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """All pages with their main text."""
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
