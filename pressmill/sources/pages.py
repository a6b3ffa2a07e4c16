"""Articles and links out of raw pages."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.dictionaries import NEWS_ADDRESSES, NEWS_TERMS, SKIP_TERMS

COLUMNS = ["page_id", "title", "body", "link", "date_text", "links", "further_pages", "sections", "is_article"]
SKIPPED = {"script", "style", "noscript"}


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What may be an article on a page of several, element kinds and classes in the order of their precedence.
CANDIDATES = [
    "article", ".article", ".news-item", ".post", ".story", ".content", ".news-content", ".blog-post", ".entry", ".news", ".headline", ".title",
    "h1", "h2", "h3", ".item", ".card", ".tile", ".block", ".section",
]
#: Kinds of elements whose text is an article's.
BODIES = {"article", "div", "section"}
#: Shapes of dates in a page's text, in the order of their precedence.
DATES = [re.compile(x) for x in (r"\d{1,2}[/-]\d{1,2}[/-]\d{4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", r"\w+ \d{1,2}, \d{4}", r"\d{1,2} \w+ \d{4}")]
#: What marks a link to a further page: parts of its address, and classes of what it stands in.
PAGE_PARTS, PAGE_CLASSES = ("page=", "/page/", "p="), {"pagination", "pager", "page-numbers", "pagination-links"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Title from the first heading, text outside scripts, and links (address, text, further page by its marks) in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.skip, self.heading = "", [], [], 0, False
        self.open, self.link = [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.skip += tag in SKIPPED
        self.heading = self.heading or (tag in HEADINGS and not self.title)
        if tag == "a" and (address := attrs.get("href")):
            marked = any(PAGE_CLASSES & names for _, names in self.open) or attrs.get("rel") == "next" or "next" in (attrs.get("title") or "").lower()
            self.link = [address, "", marked or any(x in address for x in PAGE_PARTS)]
            self.links.append(self.link)
        if tag not in VOID:
            self.open.append((tag, set((attrs.get("class") or "").split())))

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        if tag in HEADINGS:
            self.heading = False
        if tag == "a":
            self.link = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        if self.link is not None:
            self.link[1] = f"{self.link[1]} {data.strip()}".strip()
        if self.heading:
            self.title = f"{self.title} {data.strip()}".strip()
        self.text.append(data.strip())

    def further(self) -> list[str]:
        """Addresses of further pages: marked links first, then those whose text says so, then numbered ones."""
        said = [x for x in self.links if "Next" in x[1] or x[1] in {"2", "3", "4", "5"}]
        counted = [x for x in self.links if x[1].isdecimal() and 2 <= int(x[1]) <= 10]
        return [x[0] for x in [*(x for x in self.links if x[2]), *said, *counted]]


#: Bytes of HTML that are taken apart at a time; a larger page is taken alone.
PIECE_BYTES = 1 << 20


def in_pieces(pages: DataFrame, parse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas() on page_id, url, html, in frames of so many bytes: Spark's batches count rows, so that they are as large as pages are."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column("html")), 0).cast(pa.int64())).to_numpy()
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(ends.searchsorted((ends[i - 1] if i else 0) + PIECE_BYTES, "right")))
                yield batch.slice(i, j - i).to_pandas()
                i = j

    def run(batches):
        for found in parse(pieces(batches)):
            yield pa.RecordBatch.from_pandas(found, kinds, preserve_index=False)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def extract_articles(pages: DataFrame, least_title: int = 8, least_text: int = 30, most_links: int = 5) -> DataFrame:
    """For each page (page_id, url, html): page_id, title, body, link, date_text, links, further_pages, sections, is_article.

    link is the first one, links, further_pages and sections ("More from ...") are absolute, distinct and in order of
    appearance, the first few; date_text is the first date by the order of its shapes.  A page is an article if its title and
    text are long enough.  Null or broken HTML gives what can be read of it.
    """

    def absolute(url: str | None, found: list[str]) -> list[str]:
        usable = (x for x in found if not x.startswith(("#", "javascript:", "mailto:")))
        return list(dict.fromkeys(y for x in usable if (y := urljoin(url or "", x)) != url))[:most_links]

    def parse(batches):
        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf.page_id, pdf.url, pdf.html, strict=True):
                page = _Page()
                page.feed(html or "")
                page.close()
                body = " ".join(" ".join(page.text).split())
                date = next((m[0] for x in DATES if (m := x.search(body))), None)
                links = absolute(url, [x[0] for x in page.links])
                sections = absolute(url, [x[0] for x in page.links if "More from" in x[1]])
                is_article = len(page.title) > least_title and len(body) > least_text
                rows.append((page_id, page.title, body, links[0] if links else None, date, links, absolute(url, page.further()), sections, is_article))
            yield pd.DataFrame(rows, columns=COLUMNS)

    kinds = ["long", "string", "string", "string", "string", "array<string>", "array<string>", "array<string>", "boolean"]
    return in_pieces(pages, parse, ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds, strict=True)))


@dataclass
class _Element:
    """An element; its descendants are the elements from its own number up to ``end``, its text the strings first to last."""

    tag: str
    classes: set[str]
    address: str | None
    first: int
    last: int = -1
    end: int = -1


class _Elements(HTMLParser):
    """Elements in document order and strings outside scripts; what is left open ends with its parent or the page."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.elements, self.strings, self.open, self.skip = [], [], [], 0
        self.feed(html or "")
        self.close()
        self._end(0)
        self.headings = [i for i, e in enumerate(self.elements) if e.tag in HEADINGS]
        self.links = [i for i, e in enumerate(self.elements) if e.tag == "a" and e.address is not None]

    def _end(self, depth: int):
        for i in self.open[depth:]:
            self.elements[i].last, self.elements[i].end = len(self.strings), len(self.elements)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.skip += tag in SKIPPED
        self.elements.append(_Element(tag, set((attrs.get("class") or "").split()), attrs.get("href"), len(self.strings)))
        self.open.append(len(self.elements) - 1)
        if tag in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]].tag == tag:
                self._end(depth)
                break

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.strings.append(" ".join(data.split()))

    def text(self, i: int) -> str:
        return " ".join(self.strings[self.elements[i].first : self.elements[i].last])

    def inside(self, numbers: list[int], i: int) -> int | None:
        """The first of ascending element numbers among the descendants of element i."""
        at = bisect_right(numbers, i)
        return numbers[at] if at < len(numbers) and numbers[at] < self.elements[i].end else None

    def candidates(self) -> list[int]:
        """Elements that may be articles, by the order of CANDIDATES and then of the page, each once."""
        found = {}
        for kind in CANDIDATES:
            for i, e in enumerate(self.elements):
                if (kind[1:] in e.classes) if kind[0] == "." else e.tag == kind:
                    found.setdefault(i)
        return list(found)


def segment_articles(pages: DataFrame, least_title: int = 8, least_text: int = 30, most: int = 25, skip: Sequence[str] = tuple(SKIP_TERMS), news: Sequence[str] = tuple(NEWS_TERMS), addresses: Sequence[str] = tuple(NEWS_ADDRESSES)) -> DataFrame:
    """page_id, place, kind, title, body, link, date_text: the articles of pages (page_id, url, html) that may hold several.

    A candidate is an element of certain kinds or classes, the first ``most`` of a page by precedence and then position (place, from 0);
    candidates may lie in each other.  Its title is its first heading, its body its text if it is a block, its link the first one in
    it.  On a page without candidates, links with news terms in their text or address, and none of the skip list, are taken, each its own title
    and body.  An article needs more than ``least_title`` characters of title, more than ``least_text`` of body, and no term of
    the skip list in it.  Null or broken HTML gives what can be read of it.
    """

    def has(text: str, terms: Sequence[str]) -> bool:
        return any(x in text for x in terms)

    def articles(url: str | None, html: str | None):
        page = _Elements(html)
        chosen = page.candidates()
        if not chosen:
            for i in page.links:
                text, address = page.text(i).lower(), page.elements[i].address.lower()
                if len(text) > 15 and (has(address, news) or has(text, news) or has(address, addresses)) and not has(address, skip) and not has(text, skip):
                    chosen.append(i)
        for at, i in enumerate(chosen[:most]):
            e, heading, link = page.elements[i], page.inside(page.headings, i), page.inside(page.links, i)
            own = page.text(i)
            title = page.text(heading) if heading is not None else own if e.tag == "a" else ""
            body = own if e.tag in BODIES or e.tag == "a" else ""
            address = e.address if e.tag == "a" else page.elements[link].address if link is not None else None
            if len(title) > least_title and len(body) > least_text and not has(body.lower(), skip):
                date = next((m[0] for x in DATES if (m := x.search(own))), None)
                yield at, e.tag, title, body, urljoin(url or "", address) if address is not None else None, date

    def parse(batches):
        for pdf in batches:
            rows = [(page_id, *x) for page_id, url, html in zip(pdf.page_id, pdf.url, pdf.html, strict=True) for x in articles(url, html)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "kind", "title", "body", "link", "date_text"])

    return in_pieces(pages, parse, "page_id long, place int, kind string, title string, body string, link string, date_text string")
