"""The main text of web pages.

Method: one pass over the events of the standard library's streaming parser cuts a page into lines (blocks), each with its
characters and its tags.  The text-to-tag ratios, smoothed by a Gaussian over neighbouring lines, are clustered by a
threshold, their standard deviation; lines above it speak for the elements around them, lines below it against them.  The
element with the largest sum is the content region, or the article around it if there is one.  Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are known by element or by class and left out.

An article or main element is left out for its class only where readers wrote it, and no element for a name that says what it has or
lacks.

All blocks of the region are kept, short ones too.  Defined results: a null or empty page gives an empty text; broken or
unclosed markup is read as far as it goes, and an article ends a menu or header that is still open; a very long page is read as a
stream of events, so only its lines are held; regions of the same score go to the later one; repeated rows are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNSEEN = frozenset("head script style template noscript title iframe object svg math canvas audio video select option textarea button".split())
ASIDE = frozenset("nav footer aside form fieldset dialog menu".split())
REGION = frozenset("body article main section div td center".split())
WHOLE = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login paywall share sharing social related recommended recommendations comment comments reply replies respond disqus discussion widget "
    "pagination pager toolbar skip hidden".split())
# What readers add, also where it is an article.
READERS = frozenset("comment comments reply replies respond disqus discussion".split())
# A name with one of these words tells what an element has or lacks, not what it is.
MODIFIERS = frozenset("has with no without not free".split())
# Menus and page headers hold no article; an article in one means that its end tag is missing.
BEFORE_ARTICLE = frozenset("nav header menu".split())
TOP_NAMES = frozenset("header topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Lines(HTMLParser):
    """Collects (text, tags, elements around) of each line, and which elements are open at which lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []   # name, number of the element, whether it is left out
        self.names: list[str] = []
        self.lines: list[tuple[str, int, tuple[int, ...]]] = []
        self.words: list[str] = []
        self.tags = 0

    @property
    def out(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def end_line(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words = []
            if text:
                around = tuple(n for name, n, _ in self.open if name in REGION)
                self.lines.append((text, self.tags, around))
                self.tags = 0

    def pop_to(self, i: int) -> None:
        self.end_line()
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if self._left_out(tag, attrs):
                self._push(tag, True)
            return
        if tag == "br":
            self.words.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            return
        if tag in CLOSES_P:
            self._close(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            self._close(CLOSES[tag], LIMITS[tag])
        if tag in WHOLE and self.out:
            unclosed = next((i for i, (name, _, out) in enumerate(self.open) if out and name in BEFORE_ARTICLE), None)
            if unclosed is not None and all(name not in WHOLE for name, _, _ in self.open[unclosed:]):
                self.pop_to(unclosed)
        self.end_line()
        self._push(tag, self.out or tag in UNSEEN or self._left_out(tag, attrs))

    def _push(self, tag: str, out: bool) -> None:
        if out:
            self.end_line()
        self.open.append((tag, len(self.names), out))
        self.names.append(tag)

    def _close(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in names:
                self.pop_to(i)
                return
            if name in limits or name in REGION:
                return

    def _left_out(self, tag: str, attrs) -> bool:
        within = any(name in WHOLE for name, _, _ in self.open)
        if tag in ASIDE or tag == "header" and not within:
            return True
        if not attrs or tag in ("html", "body"):
            return False
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if key in ("class", "id"):
                found = set()
                for name in value.split():
                    words = {w.lower() for w in WORD.findall(name)}
                    if not words & MODIFIERS:
                        found |= words
                if found & (READERS if tag in WHOLE else NAMES) or found & TOP_NAMES and not within and tag not in WHOLE:
                    return True
            elif key == "role" and value.lower() in ROLES or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
        return False

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if not self.out:
            self.words.append(data)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """A Gaussian over neighbouring lines; the borders repeat the kernel's weight inside."""
    radius = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[lo - i + radius:hi - i + radius]
        out.append(sum(map(float.__mul__, weights, values[lo:hi])) / sum(weights))
    return out


def main_lines(html: str) -> list[str]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, names = parser.lines, parser.names
    if not lines:
        return []
    ratios = smoothed([len(text) / (tags + 1) for text, tags, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), mean)
    score: dict[int, float] = {}
    for (_, _, around), ratio in zip(lines, ratios, strict=True):
        for n in around:
            score[n] = score.get(n, 0.0) + ratio - threshold
    if not score:
        return [text for text, _, _ in lines]
    best = max(score, key=lambda n: (score[n], n))
    around = next(a for _, _, a in lines if best in a)
    whole = [n for n in around[:around.index(best) + 1] if names[n] in WHOLE]
    region = whole[0] if whole else best
    return [text for text, _, a in lines if region in a]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    common.ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            found = ["\n".join(main_lines(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
