"""Anchors, translation scope, placeholders, evidence, chat context."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.operators.walks import walked, within

#: Block kinds that are translated. Fixed values.
TRANSLATED = ("paragraph", "heading", "figure", "table", "list", "quote", "theorem", "footnote")


def reanchor(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of notes (note_id, doc_id, block_id, quote) against a new revision's blocks (doc_id, block_id, position, text): kept
    where the block lives on, moved to the first block that holds the quote, else orphaned."""
    alive = blocks.select("doc_id", "block_id", F.lit(True).alias("_alive"))
    known = notes.join(alive, ["doc_id", "block_id"], "left")
    lost = known.where("_alive IS NULL AND quote <> ''")
    found = lost.join(blocks.select("doc_id", F.col("block_id").alias("_new"), "position", "text"), "doc_id").where(F.contains("text", F.col("quote")))
    moved = found.groupBy("note_id").agg(F.min_by("_new", "position").alias("_new"))
    how = F.when(F.col("_alive"), "kept").when(F.col("_new").isNotNull(), "moved").otherwise("orphaned")
    return known.join(moved, "note_id", "left").select("note_id", "doc_id", F.when(F.col("_alive"), F.col("block_id")).otherwise(F.col("_new")).alias("block_id"), how.alias("how"))


def in_scope(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """scope: body, appendix or none. A section of references is in no scope; from the first appendix heading on, sections
    are appendix; kinds that are not translated are in no scope. headings: (doc_id, section, heading)."""
    title = F.lower(F.trim(F.regexp_replace("heading", r"^[0-9.\s]+", "")))
    marked = headings.select("doc_id", "section", title.isin("references", "bibliography").alias("_refs"), (title.rlike(r"^appendix\b") | F.col("heading").rlike(r"^[A-H][.\s]\s*\S")).alias("_app"))
    w = Window.partitionBy("doc_id").orderBy("section")
    marked = marked.withColumn("_app", F.max("_app").over(w))
    joined = blocks.join(marked, ["doc_id", "section"], "left")
    scope = F.when(~F.col("kind").isin(*TRANSLATED) | F.coalesce("_refs", F.lit(False)), "none").when(F.coalesce("_app", F.lit(False)), "appendix").otherwise("body")
    return joined.withColumn("scope", scope).drop("_refs", "_app")


def with_placeholders(text: Column) -> Column:
    """struct(text, values): inline math, code and citations become ⟦0⟧, ⟦1⟧ …, and their texts are listed. So does what looks
    like such a mark in the text itself, so that every mark of the result is one of these."""
    pattern = r"(\$[^$]+\$|`[^`]+`|\[[0-9, ]+\]|⟦[0-9]+⟧)"
    values = F.regexp_extract_all(text, F.lit(pattern), 1)
    # Split at the pattern; between the parts stand the placeholders in order.
    parts = F.split(text, pattern)
    filled = F.zip_with(parts, F.sequence(F.lit(0), F.size(parts) - 1), lambda p, i: F.concat(p, F.when(i < F.size(values), F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧"))).otherwise("")))
    return F.struct(F.array_join(filled, "").alias("text"), values.alias("values"))


def restored(text: Column, values: Column) -> Column:
    """The text with its placeholders replaced by their values, all at once; a mark without a value stays."""
    marks = F.regexp_extract_all(text, F.lit("⟦([0-9]+)⟧"), 1)
    value = lambda m: F.coalesce(F.get(values, m.try_cast("int")), F.concat(F.lit("⟦"), m, F.lit("⟧")))
    return F.array_join(F.zip_with(F.split(text, "⟦[0-9]+⟧"), marks, lambda p, m: F.concat(p, F.when(m.isNull(), "").otherwise(value(m)))), "")


def placeholders_intact(encoded: Column, translated: Column) -> Column:
    """Whether both hold the same placeholders equally often."""
    bag = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit("(⟦[0-9]+⟧)"), 1))
    return bag(encoded) == bag(translated)


def verified_quotes(quotes: DataFrame, wanted: float = 0.8) -> DataFrame:
    """Of (id, quote, text): contained, matched (the longest common stretch is `wanted` of the quote or more) or dropped."""

    @F.pandas_udf(T.DoubleType())
    def longest(quote: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, q, t, autojunk=False).find_longest_match(0, len(q), 0, len(t)).size / len(q) if q and t else 0.0 for q, t in zip(quote, text)])

    contained = F.contains("text", F.col("quote")) & (F.length("quote") > 0)
    exact = quotes.where(contained).withColumn("how", F.lit("contained"))
    rest = quotes.where(~F.coalesce(contained, F.lit(False)))
    return exact.unionByName(rest.withColumn("how", F.when(longest("quote", "text") >= wanted, "matched").otherwise("dropped")))


def promoted_sections(sections: DataFrame, budget: int) -> DataFrame:
    """promoted: of (doc_id, section, anchored, matches, tokens), those that fit the budget; anchored ones first, then by
    matches, then by place, and a section that does not fit is skipped, not the end."""
    found = walked(sections, "doc_id", [F.desc("anchored"), F.desc("matches"), "section"], ["tokens"], within(budget), "promoted", T.BooleanType())
    return found.select("doc_id", "section", "promoted")


def assigned_pairs(pairs: DataFrame) -> DataFrame:
    """Of (doc_id, a, b, score), a one-to-one choice: the best score first, ties by a, then b."""
    def begin() -> Callable:
        seen_a, seen_b = set(), set()

        def step(a, b) -> bool:
            ok = a not in seen_a and b not in seen_b
            if ok:
                seen_a.add(a)
                seen_b.add(b)
            return ok

        return step

    order = [F.desc("score"), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()]
    return walked(pairs, "doc_id", order, ["a", "b"], begin, "_chosen", T.BooleanType()).where("_chosen").drop("_chosen")


def claims(blocks: DataFrame, cues: tuple[str, ...], top_n: int = 30) -> DataFrame:
    """(doc_id, position, score): two for each cue word and one for each different camel or snake identifier, of texts of 40
    characters or more; the best top_n of a document, ties by position."""
    lower = F.lower("text")
    cue = sum((F.contains(lower, F.lit(c)).cast("int") for c in cues), F.lit(0)) * 2
    names = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([a-z]+(?:[A-Z][a-z0-9]+)+|[a-z0-9]+(?:_[a-z0-9]+)+)\b"), 1)))
    scored = blocks.where(F.length("text") >= 40).withColumn("score", (cue + names).cast("int")).where("score > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "position")
    return scored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n).select("doc_id", "position", "score")


def known_evidence(ids: Column, known: Column) -> Column:
    """The ids that exist, in their order, once each."""
    return F.filter(F.array_distinct(ids), lambda i: F.array_contains(known, i))


def reference_matches(references: DataFrame, own: DataFrame) -> DataFrame:
    """references (ref_id, arxiv_id) against own papers (paper_id, arxiv_id), versions stripped."""
    base = lambda c: F.regexp_replace(F.lower(c), r"v[0-9]+$", "")
    return references.withColumn("_k", base("arxiv_id")).join(own.select("paper_id", base("arxiv_id").alias("_k")), "_k", "left").drop("_k")


def discovered(resources: DataFrame, limits: dict[str, int], total: int = 13) -> DataFrame:
    """Of (paper_id, kind, kind_order, url, rank_value, position): per kind the best by rank_value up to its limit, one of
    each url (scheme, www. and case apart), and `total` at most, in order of kinds."""
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    w = Window.partitionBy("paper_id", "kind").orderBy(F.desc("rank_value"), "position")
    top = resources.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.coalesce(F.try_element_at(limit, F.col("kind")), F.lit(1)))
    key = F.lower(F.regexp_replace(F.regexp_replace(F.col("url"), r"^[a-zA-Z]+://(www\.)?", ""), "/+$", ""))
    order = ["kind_order", "_k"]
    first = top.withColumn("_u", key).withColumn("_d", F.row_number().over(Window.partitionBy("paper_id", "_u").orderBy(*order))).where("_d = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))).where(F.col("place") <= total).drop("_k", "_u", "_d")
