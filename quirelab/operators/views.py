"""What lists, cards and exports show: labels, policies, order, selections, transitions of single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quirelab.operators.search import ranked
from quirelab.operators.walks import walked, within

#: Licence policies: whether figures may be embedded, a credit is needed, and the same licence must be given. Fixed values.
LICENCES = (
    ("cc-by-4.0", "allow", True, False),
    ("cc-by-sa-4.0", "allow", True, True),
    ("cc0", "allow", False, False),
    ("arxiv-nonexclusive", "link_card", True, False),
    ("unknown", "link_card", True, False),
)
BLOCKING = ("number_mismatch", "untranslated")


def licence_policies(rows: DataFrame, licence: str) -> DataFrame:
    """embed, credit, share_alike of each row's licence; those of `unknown` where it is not in the table."""
    table = rows.sparkSession.createDataFrame(LICENCES, "_licence string, embed string, credit boolean, share_alike boolean")
    known = [x[0] for x in LICENCES]
    key = F.when(F.lower(licence).isin(known), F.lower(licence)).otherwise("unknown")
    return rows.withColumn("_licence", key).join(F.broadcast(table), "_licence").drop("_licence")


def vocabulary_view(rows: DataFrame, today: str, kind: str | None = None, due: bool = False, needle: str | None = None) -> DataFrame:
    """Entries of a kind, those due (not mastered, next review not after today), and those with the needle in a text column."""
    found = rows
    if kind:
        found = found.where(F.col("kind") == kind)
    if due:
        found = found.where(~F.col("mastered") & (F.col("next_review") <= F.lit(today).cast("date")))
    if needle:
        pattern = f"%{needle}%"
        found = found.where(F.col("term").ilike(pattern) | F.col("meaning").ilike(pattern) | F.col("context").ilike(pattern))
    return found


def annotation_order() -> list[Column]:
    """Placed annotations by place, start and time; unplaced ones after them, newest first."""
    return [F.col("orphaned"), F.when(~F.col("orphaned"), F.col("position")).asc_nulls_last(), F.when(~F.col("orphaned"), F.col("start")).asc_nulls_last(), F.when(~F.col("orphaned"), F.col("created")).asc_nulls_last(), F.when(F.col("orphaned"), F.col("created")).desc_nulls_last(), F.col("id")]


def after_group(groups: DataFrame, order: list[Column], id_col: str, last_id, limit: int) -> DataFrame:
    """The page of a ranked result list of any length after an id; from the top where the id is not in the list."""
    places = ranked(groups, id_col, order)
    start = places.agg(F.coalesce(F.max(F.when(F.col("id") == last_id, F.col("rank") + 1)), F.lit(0)).alias("_start"))
    page = places.join(F.broadcast(start), (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + limit))
    return groups.join(F.broadcast(page.select(F.col("id").alias(id_col))), id_col)


def matched_in(source: Column, translation: Column) -> tuple[Column, Column]:
    """Which sides a hit stands in, and the language of its snippet (the source's first)."""
    sides = F.array_compact(F.array(F.when(source, F.lit("source")), F.when(translation, F.lit("translation"))))
    return sides, F.when(source, "source").otherwise("translation")


def display_label(kind: Column, ordinal: Column, heading: Column, page: Column, quality: Column) -> Column:
    number = ordinal.cast("string")
    label = F.when(kind == "figure", F.concat_ws(" ", F.lit("Fig."), number)).when(kind == "table", F.concat_ws(" ", F.lit("Table"), number)).when(kind == "equation", F.concat(F.lit("Eq. ("), number, F.lit(")"))).when(kind == "heading", heading).otherwise(F.concat_ws(" ", heading, F.concat(F.lit("¶"), number)))
    return F.when((quality == "B") & page.isNotNull(), F.concat_ws(" · ", label, F.concat(F.lit("p. "), page.cast("string")))).otherwise(label)


def chat_snippet(question: Column, answer: Column, own_is_answer: Column) -> Column:
    """The hit's own side, and the first 60 characters of the other."""
    other = F.when(own_is_answer, question).otherwise(answer)
    own = F.when(own_is_answer, answer).otherwise(question)
    return F.concat_ws(" — ", own, F.substring(other, 1, 60))


def context_sentence(text: Column, term: Column) -> Column:
    """struct(sentence, start, end): the sentence that holds the term first, and where the term stands in it (from 0)."""
    lower, needle = F.lower(text), F.lower(term)
    having = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), needle))
    found = F.when(F.contains(lower, needle), F.get(having, F.lit(0)))
    start = F.call_function("locate", needle, F.lower(found)) - 1
    return F.struct(found.alias("sentence"), start.alias("start"), (start + F.length(term)).alias("end"))


def review_text(mastered: Column, days: Column, count: Column) -> Column:
    when = F.when(days <= 0, "today").when(days == 1, "tomorrow").otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
    return F.when(mastered, "mastered").otherwise(F.concat(when, F.lit(" (review "), (count + 1).cast("string"), F.lit(")")))


def finished_at(old: Column, status: Column, now: Column) -> Column:
    """Set once when an item is done, never overwritten."""
    return F.coalesce(old, F.when(status == "done", now))


def fresh_notifications(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New notifications of which there is no unread one with the same keys, one of each."""
    return new.dropDuplicates(keys).join(existing.where("NOT read").select(*keys), keys, "left_anti")


def stale_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """stale: whether a succeeded run is of another commit than its paper's current one."""
    joined = runs.join(current.select("paper_id", F.col("commit").alias("_current")), "paper_id", "left")
    return joined.withColumn("stale", (F.col("state") == "succeeded") & F.col("_current").isNotNull() & (F.col("commit") != F.col("_current"))).drop("_current")


def promoted_terms(user: DataFrame, paper: DataFrame) -> DataFrame:
    """A user's glossary after a paper's terms were promoted into it: overwritten or added by lower-cased term."""
    a, b = user.select(F.lower("term").alias("k"), F.col("term").alias("t1"), F.col("translation").alias("x1")), paper.select(F.lower("term").alias("k"), F.col("term").alias("t2"), F.col("translation").alias("x2"))
    return a.join(b, "k", "full").select(F.coalesce("t1", "t2").alias("term"), F.coalesce("x2", "x1").alias("translation"))


def accepted_candidates(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """(candidate_id, entry_id, action): linked to the entry of the same term, else one is created."""
    own = entries.groupBy(F.lower(F.trim("term")).alias("k")).agg(F.min("entry_id").alias("entry_id"))
    joined = candidates.withColumn("k", F.lower(F.trim("term"))).join(own, "k", "left")
    return joined.select("candidate_id", "entry_id", F.when(F.col("entry_id").isNull(), "created").otherwise("linked").alias("action"))


def slide_material(blocks: DataFrame, ranks: dict[str, int], budget: int) -> DataFrame:
    """(doc_id, position): blocks by their section's rank and place while the characters last, skipping what does not fit."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col("kind")), F.lit(99))
    rows = blocks.select("doc_id", "position", rank.alias("rank"), F.length("text").alias("n"))
    chosen = walked(rows, "doc_id", ["rank", F.col("position").asc_nulls_last()], ["n"], within(budget), "chosen", BooleanType())
    return chosen.where("chosen").select("doc_id", "position")


def rendered_context(blocks: DataFrame) -> DataFrame:
    """(doc_id, context): a header for each section and a line for each of its blocks, in order."""
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("text"))
    sections = blocks.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("r"))
    texts = sections.select("doc_id", "section", F.concat(F.lit("## "), F.col("section").cast("string"), F.lit("\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("t"))
    return texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "t"))).alias("s")).select("doc_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("context"))


def published(blocks: Column, allowed: tuple[str, ...]) -> Column:
    """Blocks of an article that may be published: allowed kinds, evidence reduced to titles."""
    return F.transform(F.filter(blocks, lambda b: b["kind"].isin(*allowed)), lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), F.transform(b["evidence"], lambda e: e["title"]).alias("evidence")))
