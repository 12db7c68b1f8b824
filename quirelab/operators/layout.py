"""Lines of pages: body size, reading order, headings, references, paragraphs, boxes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quirelab.operators.walks import walked

#: Words that are headings by themselves. Fixed values.
HEADINGS = ("abstract", "introduction", "related work", "method", "methods", "results", "discussion", "conclusion", "conclusions", "references", "acknowledgments", "appendix")
MATH = r"[=+\-*/^_<>∑∏∫√≤≥≈∈∀∃αβγδθλμπσω()\[\]{}|0-9]"


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, size): the most frequent font size to 0.1; of equally frequent ones the one that stands first."""
    sizes = lines.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("p"))
    return sizes.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("p"))).alias("size"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the value at place n div 2 of the sorted values, counted from 0; not interpolated."""
    w = Window.partitionBy(group)
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select(group, F.col(value).alias("median"))


def reading_order(lines: DataFrame, middle: float = 300) -> DataFrame:
    """order: top to bottom on pages of one column; on pages of two (a third of the lines or more on either side) the left
    before the right one."""
    page = Window.partitionBy("doc_id", "page")
    left, right = F.avg((F.col("x") < middle).cast("double")).over(page), F.avg((F.col("x") >= middle).cast("double")).over(page)
    column = F.when((left >= 1 / 3) & (right >= 1 / 3), (F.col("x") >= middle).cast("int")).otherwise(0)
    ordered = lines.withColumn("column", column)
    return ordered.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "column", "y", "x", "position")))


def column_order(lines: DataFrame) -> DataFrame:
    """order: places of lines (doc_id, page, position, x0, x1, y0, y1, width). A page has two columns where 85 % of its lines do
    not cross the middle band (12 % of the width on either side) and 16 points or more lie between those left and right of it;
    else it is read by y, then x. Of two columns the left comes first; lines that cross, or stand in the band, come before both
    if they end above them, and after both otherwise."""
    page = Window.partitionBy("doc_id", "page")
    half, centre = F.col("width") / 2, (F.col("x0") + F.col("x1")) / 2
    low, high = F.col("width") * 0.38, F.col("width") * 0.62
    crosses = (F.col("x0") < low) & (F.col("x1") > high)
    banded = lines.withColumns({"_crosses": crosses, "_between": crosses | centre.between(low, high), "_right": centre >= half})
    side = lambda right, value: F.when(~F.col("_between") & (F.col("_right") == right), value)
    gutter = F.min(side(True, F.col("x0"))).over(page) - F.max(side(False, F.col("x1"))).over(page)
    two = (F.avg((~F.col("_crosses")).cast("double")).over(page) >= 0.85) & (gutter >= 16)
    top = F.min(F.when(~F.col("_between"), F.col("y0"))).over(page)
    known = banded.withColumns({"_two": F.coalesce(two, F.lit(False)), "_top": top})
    part = F.when(~F.col("_two"), 0).when(F.col("_between"), F.when(F.col("y1") <= F.col("_top") + 1e-6, 0).otherwise(3)).when(F.col("_right"), 2).otherwise(1)
    y = F.when(F.col("_two"), F.col("y0")).otherwise(F.round("y0", 1))
    placed = known.withColumns({"_part": part, "_y": y}).withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_part", "_y", "x0", "position")))
    return placed.select(*lines.columns, F.col("_two").alias("two_columns"), "order")


def running_lines(lines: DataFrame, text: Column) -> DataFrame:
    """lines (doc_id, page, y0, y1, height …) with `running`: page numbers, and texts that stand on 60 % of the document's pages
    or more with digits taken as equal, in the upper 56 or lower 48 points of a page."""
    band = (F.col("y1") <= 56) | (F.col("y0") >= F.col("height") - 48)
    same = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\p{Nd}", "#")
    number = F.trim(text).rlike(r"^[0-9]{1,4}$")
    marked = lines.withColumns({"_same": F.when(band & ~number, F.nullif(same, F.lit(""))), "_number": band & number})
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_all"))
    often = marked.where("_same IS NOT NULL").groupBy("doc_id", "_same").agg(F.countDistinct("page").alias("_n")).join(pages, "doc_id").where("_n * 10 >= _all * 6")
    found = marked.join(often.select("doc_id", "_same", F.lit(True).alias("_often")), ["doc_id", "_same"], "left")
    return found.withColumn("running", F.coalesce(F.col("_number") | F.col("_often"), F.col("_number"), F.col("_often"), F.lit(False))).select(*lines.columns, "running")


def is_heading(text: Column, size: Column, body: Column, bold: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(text, r"^[0-9.\s]+", "")))
    numbered = text.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+\S")
    return plain.isin(*HEADINGS) | (((size >= body + 1.4) | bold) & numbered)


def is_display_equation(text: Column, x0: Column, x1: Column, middle: Column) -> Column:
    """Centred within 6 points, and a quarter of the characters or more are mathematical."""
    visible = F.regexp_replace(text, r"\s", "")
    share = F.regexp_count(visible, F.lit(MATH)) / F.greatest(F.length(visible), F.lit(1))
    return (F.abs((x0 + x1) / 2 - middle) <= 6) & (share >= 0.25)


def grouped_references(lines: DataFrame) -> DataFrame:
    """(doc_id, reference, text): lines from one marker ([1], 1. or (1)) to before the next; what stands before the first
    marker is reference 0."""
    starts = F.col("text").rlike(r"^\s*(\[[0-9]+\]|[0-9]+\.|\([0-9]+\))\s").cast("int")
    numbered = lines.withColumn("reference", F.sum(starts).over(Window.partitionBy("doc_id").orderBy("position")))
    return numbered.groupBy("doc_id", "reference").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("r")).select("doc_id", "reference", joined(F.transform("r", lambda x: x["text"])).alias("text"))


def joined(parts: Column) -> Column:
    """Lines joined by spaces; a hyphen at a line's end before a small letter goes with the line break."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(parts, "\n"), r"(?<=\p{L})-\n(?=\p{Ll})", ""), r"\s*\n\s*", " "))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, position, paragraph): a new paragraph where the page changes, the gap to the line above is outside 0 to 0.9
    line heights, or a line is indented by more than 8 points against the paragraph's first line.

    The last rule looks at the current group's first line, so each document's lines are walked in order."""
    def begin() -> Callable:
        paragraph, above, first_x = -1, None, 0.0

        def step(*values) -> int:
            nonlocal paragraph, above, first_x
            # A missing value equals none, so that a line without page, place or height begins a paragraph.
            page, x, y, height = (math.nan if v is None else v for v in values)
            if above is None or page != above[0] or not 0 <= y - above[1] - height <= 0.9 * height or x - first_x > 8:
                paragraph, first_x = paragraph + 1, x
            above = page, y
            return paragraph

        return step

    rows = lines.select("doc_id", "position", "page", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "height")))
    return walked(rows, "doc_id", [F.col("position").asc_nulls_last()], ["page", "x", "y", "height"], begin, "paragraph", IntegerType()).select("doc_id", "position", "paragraph")


def continued_paragraphs(rows: DataFrame) -> DataFrame:
    """merged: of (doc_id, paragraph, page, text), the number of the paragraph that each one belongs to once those that go on
    over a page break are joined: no sentence end before it, a small letter at its start."""
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    goes_on = (F.lag("page").over(w) != F.col("page")) & ~F.lag("text").over(w).rlike(r"[.!?:。！？]\s*$") & F.col("text").rlike(r"^\p{Ll}")
    marked = rows.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    return marked.withColumn("merged", F.sum("_new").over(w) - 1).drop("_new")


def intersection_over_union(a: list[Column], b: list[Column]) -> Column:
    """Of boxes (x0, y0, x1, y1)."""
    width = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def thumbnail(figures: DataFrame) -> DataFrame:
    """Each document's figure 1, else its largest, else its first."""
    order = F.struct((F.col("number") != "1").alias("a"), (-F.coalesce("area", F.lit(0))).alias("b"), F.col("position").alias("c"))
    return figures.groupBy("doc_id").agg(F.min_by("position", order).alias("position"))
