"""HTML pages to block rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_BLOCK = {"p": "paragraph", "li": "list", "pre": "code", "blockquote": "quote", "figcaption": "figure", "caption": "table", "td": "table", "th": "table", "dd": "paragraph", "dt": "paragraph"}
_SKIP = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "head"}


class _Blocks(HTMLParser):
    """Headings, paragraphs, lists, tables, figures, code and quotes in page order; a heading opens a section."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, str, str]] = []
        self.section, self.kind, self.skipped = 0, "", 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text and self.kind:
            if self.kind == "heading":
                self.section += 1
            self.rows.append((len(self.rows), self.section, self.kind, text))

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _SKIP:
            self.flush()
            self.skipped += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.kind = "heading"
        elif tag in _BLOCK:
            self.flush()
            self.kind = _BLOCK[tag]
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag) -> None:
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
            self.parts = []
        elif tag in _BLOCK or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.flush()
            self.kind = ""

    def handle_data(self, data) -> None:
        if not self.skipped and self.kind:
            self.parts.append(data)


def blocks_of(page: str | None) -> list[tuple[int, int, str, str]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.rows


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, position, section, kind, text) of each page's blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *row) for i, page in zip(batch["page_id"], batch["html"]) for row in blocks_of(page)], columns=["page_id", "position", "section", "kind", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, section int, kind string, text string")
