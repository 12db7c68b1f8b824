"""Counts of annotations and vocabulary, sections and their units, rebuilt and copied sets, claims, attempts and log timelines.

Cases: null keys form a group of their own unless said otherwise; empty inputs give empty results (counts of whole tables one
row of zeros). Repeated rows count as often as they stand. Columns besides those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of annotations, in order; kinds of vocabulary entries.
COLOURS = ("yellow", "green", "blue", "pink", "purple")
KINDS = ("word", "idiom", "term")


def annotation_counts(rows: DataFrame, key: str) -> DataFrame:
    """Of (key, colour, comment, block_id, kind): annotations of each colour (zero if none), with a comment, and unplaced,
    each counted whatever filters a list has."""
    colours = [F.count_if(F.col("colour") == c).alias(c) for c in COLOURS]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *colours, F.count_if(F.trim("comment") != "").alias("with_comment"), F.count_if(F.col("block_id").isNull()).alias("unplaced"))


def filtered_annotations(rows: DataFrame, colours: list[str] | None = None, has_comment: bool | None = None, placed: bool | None = None, kind: str | None = None) -> DataFrame:
    """Annotations of any of the colours, with or without a comment, placed or not, of a kind; a filter of None lets all through."""
    comment = F.coalesce(F.trim("comment") != "", F.lit(False))
    tests = [
        F.col("colour").isin(*colours) if colours is not None else None,
        comment == has_comment if has_comment is not None else None,
        F.col("block_id").isNotNull() == placed if placed is not None else None,
        F.col("kind") == kind if kind is not None else None,
    ]
    return rows.where(reduce(Column.__and__, [t for t in tests if t is not None], F.lit(True)))


def vocabulary_counts(rows: DataFrame, key: str, today: str) -> DataFrame:
    """Of (key, kind, mastered, next_review): entries of each kind, all, and those that are due."""
    due = ~F.col("mastered") & (F.col("next_review") <= F.lit(today).cast("date"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.count_if(due).alias("due"))


def timeline(log: DataFrame) -> DataFrame:
    """Of (job, n, stage, message, detail as JSON): the entries that belong in the job's timeline, in order, without details."""
    shown = F.get_json_object("detail", "$.timeline") == "true"
    w = Window.partitionBy("job").orderBy("n")
    return log.where(shown).select("job", F.row_number().over(w).cast("long").alias("entry"), "stage", "message")


def section_units(blocks: DataFrame, units: DataFrame, doc: str, section: str) -> DataFrame:
    """Blocks of sections in order with their translation's text and state; the text of a unit that is blocked is hidden."""
    found = blocks.join(units.select(doc, "block_id", F.col("text").alias("_t"), "state"), [doc, "block_id"], "left")
    shown = F.when(F.col("state") != "blocked", F.col("_t"))
    return found.select(doc, section, "block_id", F.coalesce("state", F.lit("missing")).alias("state"), shown.alias("translation"))


def ancestors(sections: DataFrame, doc: str, section: str, path: str) -> DataFrame:
    """(doc, section, ancestor, depth): a section, itself included, with all that stand above it. A section's path is the numbers
    from the root joined by dots, so that a walk up the tree is a cut of the path."""
    parts = F.split(path, r"\.")
    above = F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth")
    cut = sections.withColumn("_p", parts).select(doc, section, "_p", above).withColumn("_a", F.array_join(F.slice("_p", F.lit(1), F.col("depth")), "."))
    names = sections.select(doc, F.col(section).alias("ancestor"), F.col(path).alias("_a"))
    return cut.join(names, [doc, "_a"]).select(doc, section, "ancestor", F.col("depth").cast("long").alias("depth"))


def anchored_sections(anchors: DataFrame, blocks: DataFrame, above: DataFrame, doc: str) -> DataFrame:
    """(anchor_id, section): the sections that own an anchor's block, from the innermost to the root; above: of ancestors()."""
    own = anchors.join(blocks.select(doc, "block_id", "section"), [doc, "block_id"])
    return own.join(above, [doc, "section"]).select("anchor_id", F.col("ancestor").alias("section"), "depth")


def rebuilt(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The stored rows with all rows of the keys that fresh has replaced by fresh's; other keys' rows stay."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def own_copies(own: DataFrame, shared: DataFrame, user: str, entry: str, wanted: DataFrame) -> DataFrame:
    """Sets of the users in `wanted` (user, set_id) after the first change to a shared set: who has no rows of the set of their
    own gets a copy of the shared ones, others keep theirs. own: (user, set_id, entry, value); shared: (set_id, entry, value)."""
    missing = wanted.join(own.select(user, "set_id").distinct(), [user, "set_id"], "left_anti")
    copied = missing.join(shared, "set_id").select(user, "set_id", entry, "value", F.lit(True).alias("copied"))
    return own.select(user, "set_id", entry, "value", F.lit(False).alias("copied")).unionByName(copied)


def claimed(jobs: DataFrame, workers: int, queue: str, order: str) -> DataFrame:
    """A step of claiming: of each queue's queued jobs the first `workers` become running, all others stay as they are."""
    w = Window.partitionBy(queue).orderBy(order, "job")
    # Each task keeps its own first `workers` of a queue before they meet, so that a long queue is sorted nowhere.
    first = jobs.where("status = 'queued'").select("job", queue, order).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= workers)
    taken = jobs.join(first.select("job", F.lit(True).alias("_taken")), "job", "left").withColumn("claimed", F.coalesce("_taken", F.lit(False)))
    return taken.withColumn("status", F.when(F.col("claimed"), "running").otherwise(F.col("status"))).drop("_taken")


def marked_read(notices: DataFrame, users: list, at: str) -> DataFrame:
    """All unread notifications of these users become read at this time; others keep their time."""
    unread = F.col("user_id").isin(*users) & F.col("read_at").isNull()
    return notices.withColumn("read_at", F.when(unread, F.lit(at).cast("timestamp")).otherwise(F.col("read_at")))


def attempt_usage(attempts: DataFrame, request: str, order: str, per_provider: int) -> DataFrame:
    """Of (request, order, provider, ok, tokens): the attempts that are made when each provider is tried up to `per_provider`
    times and nothing after the first success, with their number and whether they end the request."""
    by_provider = Window.partitionBy(request, "provider").orderBy(order)
    tried = attempts.withColumn("_k", F.row_number().over(by_provider)).where(F.col("_k") <= per_provider)
    before = Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    made = tried.withColumn("_won", F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0))).where("_won = 0")
    number = F.row_number().over(Window.partitionBy(request).orderBy(order)).cast("long")
    return made.select(request, number.alias("attempt"), "provider", "ok", "tokens")
