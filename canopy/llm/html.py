"""Main text of web pages: text lengths of lines over sliding windows, between where they surge and where they dive."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common

#: Lines in a window, and characters that a window of a text must have.
WINDOW = 3
SURGE = 60

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Elements by what they do to the text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ASIDE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
NAMED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|header|footer|masthead|comment|comments|disqus|replies|respond|reviews|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommended|recommendations|widget|widgets|toolbar|pagination|pager|search)(?:$|[\s_-])"
)
CLOSES_P = BLOCK - {"br", "option", "button"}


@dataclass
class Line:
    text: str
    linked: int
    aside: bool


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, markup stripped and references decoded."""
    out: list[Line] = []
    open_: list[tuple[str, bool]] = []  # element, whether it sets text aside
    parts: list[str] = []
    linked, asides, links, at = 0, 0, 0, 0

    def end_line() -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            out.append(Line(text, linked, asides > 0))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal asides, links
        while len(open_) > depth:
            name, aside = open_.pop()
            asides -= aside
            links -= name == "a"

    def add(raw: str) -> None:
        nonlocal linked
        text = references.unescape(raw)
        parts.append(text)
        if links:
            linked += len(text)

    while m := TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if name in BLOCK:
                end_line()
            if depth is not None:
                close(depth)
            continue
        if name in BLOCK:
            end_line()
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and open_:
            # a paragraph, and what is open in it, ends where the next block begins
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in CLOSES_P), None)
            if k is not None and (open_[k][0] == "p" or open_[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(k)
        aside = name in ASIDE
        if m[3]:
            for key, value in ATTRIBUTE.findall(m[3]):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id") and name not in ("body", "html", "article", "main"):
                    aside |= bool(NAMED.search(value))
                elif key in ("class", "id") and name == "article":
                    aside |= bool(re.search(r"(?i)(?:^|[\s_-])comments?(?:$|[\s_-])", value))
                elif key == "role":
                    aside |= value.lower() in ROLES
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none", value):
                    aside = True
        open_.append((name, aside))
        asides += aside
        links += name == "a"
    if at < len(page):
        add(page[at:])
    end_line()
    return out


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs (begin, end) of lines between surge and dive points, from the sums of text lengths over sliding windows.

    A stretch has a window that reaches `surge`. It goes back from there to where the windows before
    held nothing, and ends where the windows dive to nothing; its first and last lines have text.
    """
    out: list[tuple[int, int]] = []
    total = list(accumulate(weights, initial=0))
    begin, last, peak = None, 0, 0
    for i, w in enumerate(weights):
        if not w:
            continue
        if begin is not None and i - last > window:
            if peak >= surge:
                out.append((begin, last + 1))
            begin, peak = None, 0
        begin, last = i if begin is None else begin, i
        peak = max(peak, total[i + 1] - total[max(begin, i + 1 - window)])
    if begin is not None and peak >= surge:
        out.append((begin, last + 1))
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points of the distribution of line lengths.

    Elements only strip: lines in menus, forms and the like are left out beforehand, so none parts a
    text from its tail, and lines of links weigh nothing. A page whose windows never reach `surge`
    has a short text, which is all its lines that are no links.
    """
    lines = [x for x in lines_of(page) if not x.aside]
    weights = [0 if 2 * x.linked > len(x.text) else len(x.text) for x in lines]
    found = stretches(weights, window, surge)
    if found:
        return " ".join(x.text for begin, end in found for x in lines[begin:end])
    return " ".join(x.text for x, w in zip(lines, weights, strict=True) if w)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars; a row for each row of pages.

    Null and empty pages, and pages without main text, give an empty text; pages of any length are
    read whole. Null ids and urls are kept, repeated rows are read each, other columns are not looked
    at, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "html"):
            texts = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
