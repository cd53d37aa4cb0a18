"""Alert rows from fetched web pages.

Pages are parsed one by one inside ``mapInArrow``; Spark spreads them over the
executors, and only the page's key, address and markup reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.severity import alert_key
from barograph.functions.text import classify

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
DETAILS = ["area", "issued", "effective", "expires", "severity", "certainty", "urgency"]
COLUMNS = ["parsed", "title", "text", *DETAILS, "link"]
ROW = "page_id bigint, seq int, " + ", ".join(f"{c} string" for c in COLUMNS)
ARROW_ROW = pa.schema([("page_id", pa.int64()), ("seq", pa.int32()), *[(c, pa.string()) for c in COLUMNS]])


class Element:
    """A tag with its attributes, children and text pieces in document order."""

    __slots__ = ("tag", "classes", "href", "content")

    def __init__(self, tag: str, attrs: dict):
        self.tag = tag
        self.classes = (attrs.get("class") or "").split()
        self.href = attrs.get("href")
        self.content: list = []

    def walk(self) -> Iterator[Element]:
        """All elements below this one, in document order."""
        todo = [c for c in reversed(self.content) if isinstance(c, Element)]
        while todo:
            element = todo.pop()
            yield element
            todo += [c for c in reversed(element.content) if isinstance(c, Element)]

    def pieces(self) -> Iterator[str]:
        """The text below this element, without scripts and styles."""
        todo = list(reversed(self.content))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in SILENT:
                todo += list(reversed(item.content))

    def text(self) -> str:
        return "".join(self.pieces()).strip()

    def find_all(self, tag: str, css_class: str | None = None) -> list[Element]:
        return [e for e in self.walk() if e.tag == tag and (css_class is None or css_class in e.classes)]


class PageReader(HTMLParser):
    """Builds the element tree; an end tag closes everything opened since its start tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        element = Element(tag, dict(attrs))
        self.open[-1].content.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].content.append(Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].content.append(data)


def read_page(html: str | None) -> Element:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    return reader.root


Selector = tuple[str, str | None]


@dataclass(frozen=True)
class Markup:
    """Where listed alerts stand in a page, each as tag and class (None: any class).

    Within an item, the first ``title`` has the text and the link, the first ``text``
    the body, and each ``row`` the name and the value of a detail in two ``cell``s.
    """

    item: Selector = ("div", "alert-item")
    title: Selector = ("a", "alert-title")
    row: Selector = ("div", "row")
    cell: Selector = ("div", None)
    text: Selector = ("div", "alert-text")


def listed_alerts(root: Element, base_url: str, markup: Markup = Markup()) -> Iterator[dict]:
    """Alerts in the item blocks of a page; a block without a title is left out."""
    for block in root.find_all(*markup.item):
        titles = block.find_all(*markup.title)
        if not titles:
            continue
        details = {}
        for row in block.find_all(*markup.row):
            cells = row.find_all(*markup.cell)
            if len(cells) >= 2:
                details[cells[0].text().replace(":", "").lower()] = cells[1].text()
        body = block.find_all(*markup.text)
        yield {
            "parsed": "listed",
            "title": titles[0].text(),
            "text": body[0].text() if body else "",
            "link": urljoin(base_url, titles[0].href or ""),
            **{d: details.get(d) for d in DETAILS},
        }


def loose_sections(root: Element, pattern: str, min_chars: int, max_chars: int, link: str) -> Iterator[dict]:
    """Blocks whose class contains ``pattern`` and that hold more than ``min_chars``."""
    for element in root.walk():
        if element.tag in ("div", "section") and any(pattern in c.lower() for c in element.classes):
            text = " ".join(p.strip() for p in element.pieces() if p.strip())
            if len(text) > min_chars:
                yield {"parsed": "fallback", "title": "Weather Alert", "text": text[:max_chars], "link": link}


def parse_pages(
    pages: DataFrame, base_url: str | None = None, class_pattern: str = "alert", min_chars: int = 50, max_chars: int = 1000, markup: Markup = Markup()
) -> DataFrame:
    """All alerts of all pages, in page order, before defaults are filled in.

    A page without listed alerts falls back to its loose sections. Links are
    resolved against ``base_url`` or else against the page's own address.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*batch.columns):
                base = base_url or url.as_py() or ""
                root = read_page(html.as_py())
                found = list(listed_alerts(root, base, markup))
                found = found or list(loose_sections(root, class_pattern, min_chars, max_chars, base))
                rows += [{"page_id": page_id.as_py(), "seq": i, **alert} for i, alert in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, ARROW_ROW)

    return pages.select("page_id", "url", "html").mapInArrow(parse, ROW)


def pages_to_alerts(pages: DataFrame, fetched_at: Column, **options) -> DataFrame:
    """Alert records of fetched pages; a missing issue date becomes ``fetched_at``."""
    found = parse_pages(pages, **options)
    fetched = fetched_at.cast("timestamp")
    issued = F.coalesce(F.try_to_timestamp("issued"), fetched)
    region = F.coalesce("area", F.lit("Unknown"))
    kind = F.when(F.col("parsed") == "fallback", "other").otherwise(classify(F.col("title")))
    # Fallback rows share one title, so their text takes its place in the key.
    key = F.when(F.col("parsed") == "fallback", F.concat(F.lit("fallback_"), F.sha2("text", 256))).otherwise(
        alert_key(F.col("title"), issued, region)
    )
    return found.select(
        key.alias("alert_id"),
        "title",
        "text",
        kind.alias("type"),
        region.alias("region"),
        issued.alias("issued_date"),
        F.coalesce("effective", F.lit("")).alias("effective_date"),
        F.coalesce("expires", F.lit("")).alias("expires_date"),
        *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("severity", "certainty", "urgency")],
        "link",
        fetched.alias("scraped_at"),
    )
