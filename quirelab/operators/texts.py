"""Text statistics and analysis, table grids, page positions, checks of generated output."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from quirelab.session import ship

#: Reading speeds a minute, and dollars for a million tokens in and out by model size.
CJK_CHARACTERS, WORDS = 600, 250
PRICES = {"small": (0.15, 0.6), "large": (2.5, 10.0)}
CONFIDENCE = ("high", "medium", "low")
#: Characters of a text that one row takes to Python at most, and what a row begins there: a document, a page or a block, or nothing.
PIECE = 2000
_DOCUMENT, _PAGE, _BLOCK, _ON = range(4)
#: ASCII characters that are neither letters nor digits.
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def stemmed(token: Column) -> Column:
    """A light English stemmer: plural and verbal endings of words of five letters or more."""
    for pattern, with_ in (("(?<=[a-z]{3})ies$", "y"), ("(?<=[a-z]{2}(?:s|x|z|ch|sh))es$", ""), ("(?<=[a-z]{3}[^s])s$", ""), ("(?<=[a-z]{4})(?:ing|ed)$", "")):
        token = F.regexp_replace(token, pattern, with_)
    return token


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters of the CJK runs, for languages written without spaces."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{IsHiragana}\p{IsKatakana}\p{IsHan}]{2,})"), 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def cjk_share(text: Column) -> Column:
    visible = F.regexp_replace(text, r"\s", "")
    return F.regexp_count(visible, F.lit(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]")) / F.greatest(F.length(visible), F.lit(1))


def reading_minutes(text: Column) -> Column:
    """By characters where half of them or more are CJK, else by words; one at least."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    cjk = cjk_share(text) >= 0.5
    return F.greatest(F.lit(1), F.when(cjk, F.ceil(F.length(text) / CJK_CHARACTERS)).otherwise(F.ceil(words / WORDS))).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4 * 1.1).cast("long")


def estimated_cost(tokens_in: Column, tokens_out: Column, model: str) -> Column:
    a, b = PRICES[model]
    return F.round((tokens_in * a + tokens_out * b) / 1_000_000, 8)


def iso_duration_seconds(text: Column) -> Column:
    """PT1H2M3S and P1DT… to seconds; null for anything else."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"([0-9]+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    ok = text.rlike(r"^P([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+S)?)?$") & text.rlike("[0-9]")
    return F.when(ok, part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, int, bool, str]] = []
        self.taken: set[tuple[int, int]] = set()
        self.row, self.open = -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.handle_endtag("td")
            self.row += 1
        elif tag in ("td", "th"):
            self.handle_endtag("td")
            self.row = max(self.row, 0)
            span = dict(attrs)
            size = lambda name: min(200, max(1, int(span.get(name) or 1))) if str(span.get(name) or 1).isdigit() else 1
            column = 0
            while (self.row, column) in self.taken:
                column += 1
            rows, columns = size("rowspan"), size("colspan")
            self.taken.update((self.row + r, column + c) for r in range(rows) for c in range(columns))
            self.open = (self.row, column, rows, columns, tag == "th", [])

    def handle_data(self, data):
        if self.open:
            self.open[5].append(data)

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            *place, parts = self.open
            self.cells.append((*place, " ".join("".join(parts).split())))
            self.open = None


def grid_of(table: str | None) -> list[tuple[int, int, int, int, bool, str]]:
    """(row, column, rows, columns, is header, text) of a table's cells; spans push later cells to free places."""
    parser = _Grid()
    parser.feed(table or "")
    parser.close()
    parser.handle_endtag("table")
    return parser.cells


def table_cells(tables: DataFrame, id_col: str, html_col: str) -> DataFrame:
    @F.pandas_udf("array<struct<row: int, column: int, rows: int, columns: int, header: boolean, text: string>>")
    def cells(html: pd.Series) -> pd.Series:
        return html.map(lambda t: [dict(zip(("row", "column", "rows", "columns", "header", "text"), c)) for c in grid_of(t)])

    return tables.select(id_col, F.explode(cells(html_col)).alias("c")).select(id_col, "c.*")


def _normal(t: str) -> str:
    t = t.lower()
    return t.encode().translate(None, _MARKS).decode() if t.isascii() else "".join(filter(str.isalnum, t))


def page_positions(pairs: DataFrame, wanted: float = 0.85, prefix: int = 80) -> DataFrame:
    """Of (doc_id, blocks array<string>, pages array<string>), the page of each block: the first from the last found page on
    that holds its beginning (ratio of the longest match, or of all, of `wanted` or more); pages only go forward. Null arrays are empty ones, a null
    text is the empty text, which stands on no page.

    Python reads a document as rows of PIECE characters at most, its pages before its blocks, so that a batch has a bounded size
    and a task holds the pages of one document."""

    ship(pairs.sparkSession)

    def alike(head: str, page: str) -> bool:
        # A match of that many characters holds the beginning's middle; a ratio cannot exceed what the lengths allow.
        least = math.ceil(wanted * len(head) - 1e-9)
        if head[len(head) - least : least] not in page and 2 * min(len(head), len(page)) < wanted * (len(head) + len(page)) - 1e-9:
            return False
        m = SequenceMatcher(None, head, page)
        return max(m.find_longest_match(0, len(head), 0, len(page)).size / len(head), m.ratio()) >= wanted

    def place(head: str, pages: list[str], at: int) -> int | None:
        return next((k for k in range(at, len(pages)) if head in pages[k] or alike(head, pages[k])), None) if head else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the document that is read: its id, its pages, the pages of its blocks, the last one found, and the text that may go on in the next row.
        key, pages, row, at, kind, text = None, [], [], 0, None, []

        def end() -> None:
            nonlocal at
            whole = _normal("".join(text))
            if kind == _PAGE:
                pages.append(whole)
            elif kind == _BLOCK:
                row.append(place(whole[:prefix], pages, at))
                at = at if row[-1] is None else row[-1]

        for batch in batches:
            keys, found = [], []
            for k, (step, piece) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if step != _ON:
                    end()
                    text, kind = [], step
                if step == _DOCUMENT:
                    if key is not None:
                        keys.append(key)
                        found.append(row)
                    key, pages, row, at = batch.column(0).slice(k, 1), [], [], 0
                text.append(piece or "")
            if keys:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "pages"])
        if key is not None:
            end()
            yield pa.RecordBatch.from_arrays([key, pa.array([row], pa.list_(pa.int32()))], names=["doc_id", "pages"])

    def rows(kind: int, texts: str) -> Column:
        def pieces(t: Column) -> Column:
            several = F.regexp_extract_all(t, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))
            return F.transform(F.when(F.length(t) > PIECE, several).otherwise(F.array(t)), lambda p, i: F.struct(F.when(i == 0, kind).otherwise(_ON).alias("step"), p.alias("piece")))

        return F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), pieces))

    head = F.array(F.struct(F.lit(_DOCUMENT).alias("step"), F.lit(None).cast("string").alias("piece")))
    read = pairs.select("doc_id", F.explode(F.concat(head, rows(_PAGE, "pages"), rows(_BLOCK, "blocks"))).alias("r")).select("doc_id", "r.step", "r.piece")
    return read.mapInArrow(run, StructType([pairs.schema["doc_id"]]).add("pages", ArrayType(IntegerType())))


def verified_output(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (id, path, first_line, last_line, excerpt, confidence) that are about a file (path, text) that exists, lines it
    has, an excerpt that stands there and a known confidence; of equal ones the first."""
    n = F.size(F.split("text", "\n"))
    kept = findings.join(files, "path").where((F.col("first_line") >= 1) & (F.col("first_line") <= F.col("last_line")) & (F.col("last_line") <= n) & F.contains("text", F.col("excerpt")) & F.col("confidence").isin(*CONFIDENCE))
    w = Window.partitionBy("path", "first_line", "last_line", "excerpt").orderBy("id")
    return kept.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("id", "path", "first_line", "last_line", "excerpt", "confidence")


def bibliography(lines: DataFrame) -> DataFrame:
    """Of a first page's lines (doc_id, position, y_share, size, text): title (the lines of the largest font in the upper 40
    percent), author line (the next one), DOI and arXiv id found on the page."""
    upper = lines.where("y_share <= 0.4")
    w = Window.partitionBy("doc_id")
    title = upper.withColumn("_m", F.max("size").over(w)).where("size = _m")
    titles = title.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"), F.max("position").alias("_last"))
    after = lines.join(titles.select("doc_id", "_last"), "doc_id").where("position > _last").groupBy("doc_id").agg(F.min_by("text", "position").alias("authors"))
    ids = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("all"))
    some = lambda pattern: F.nullif(F.regexp_extract("all", pattern, 1), F.lit(""))
    out = titles.join(after, "doc_id", "left").join(ids, "doc_id")
    return out.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("title"), "authors", some(r"(10\.\d{4,9}/\S+)").alias("doi"), some(r"(?i)arxiv:(\d{4}\.\d{4,5})").alias("arxiv_id"))


def monotonic_segments(matches: DataFrame) -> DataFrame:
    """Of (doc_id, new_position, old_position), the matches that keep the old order, numbered as ends of segments."""
    w = Window.partitionBy("doc_id").orderBy("new_position")
    highest = F.max("old_position").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = matches.withColumn("_h", highest).where("_h IS NULL OR old_position > _h").drop("_h")
    return kept.withColumn("segment", F.row_number().over(w))
