"""How the library's entities are read from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.session import table

#: Reading states in order, quick filters, priority ranks.
STATUSES = ("planned", "up_next", "reading", "done", "reread", "on_hold")
QUICK = {"unread": ("planned", "up_next"), "in_progress": ("reading", "on_hold"), "done": ("done",), "recheck": ("reread",)}
PRIORITY_RANK = {"high": 0, "mid": 1, "low": 2}


def choose(value: Column, choices: dict) -> Column:
    """The value's entry, null without one."""
    out = F.lit(None)
    for k, v in reversed(choices.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items: item_id, user_id, paper_id, status, priority, deadline, added_on, price."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 1999).alias("paper_id"),
        choose(F.col("o_orderkey") % 6, dict(enumerate(STATUSES))).alias("status"),
        choose(F.substring("o_orderpriority", 1, 1), {"1": "high", "2": "high", "3": "mid", "4": "low"}).alias("priority"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("deadline"),
        F.col("o_orderdate").cast("date").alias("added_on"),
        F.col("o_totalprice").alias("price"),
    )


ITEMS = """items AS (SELECT o_orderkey AS item_id, o_custkey AS user_id, o_orderkey % 1999 AS paper_id,
 CASE o_orderkey % 6 WHEN 0 THEN 'planned' WHEN 1 THEN 'up_next' WHEN 2 THEN 'reading' WHEN 3 THEN 'done' WHEN 4 THEN 'reread' ELSE 'on_hold' END AS status,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'mid' WHEN '4' THEN 'low' END AS priority,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS deadline, CAST(o_orderdate AS DATE) AS added_on, o_totalprice AS price FROM orders)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers: paper_id, title, tags, brand, kind, year (null now and then)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("paper_id"),
        F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("tags"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.when(F.col("p_size") > 3, 1975 + F.col("p_size")).alias("year"),
    )


PAPERS = """papers AS (SELECT p_partkey AS paper_id, p_name AS title, string_split(p_name, ' ') AS tags, p_brand AS brand, p_type AS kind,
 CASE WHEN p_size > 3 THEN 1975 + p_size END AS year FROM part)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection entries: collection_id, item_id, position, is_self."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("collection_id"), F.col("l_orderkey").alias("item_id")).agg(F.min("l_linenumber").alias("position"), (F.max("l_returnflag") == "R").alias("is_self"))


ENTRIES = """entries AS (SELECT l_suppkey AS collection_id, l_orderkey AS item_id, min(l_linenumber) AS position, max(l_returnflag) = 'R' AS is_self FROM lineitem GROUP BY l_suppkey, l_orderkey)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks: doc_id, position (from 0), section (of four blocks), kind, text; empty lines are no blocks of their own kind."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return lines.select("doc_id", "position", F.floor(F.col("position") / 4).cast("int").alias("section"), F.when(F.col("position") % 4 == 0, "heading").when(F.col("position") % 7 == 3, "figure").otherwise("paragraph").alias("kind"), "text")


BLOCKS = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
 numbered AS (SELECT doc_id, parts, unnest(range(len(parts))) AS p FROM lines),
 blocks AS (SELECT doc_id, CAST(p AS INTEGER) AS position, CAST(p // 4 AS INTEGER) AS section, CASE WHEN p % 4 = 0 THEN 'heading' WHEN p % 7 = 3 THEN 'figure' ELSE 'paragraph' END AS kind, parts[p + 1] AS text FROM numbered)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading sessions and usage: event_id, user_id, ts, kind, seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), F.floor(F.col("value") * 10).cast("long").alias("seconds"), "props")


SESSIONS = """sessions AS (SELECT event_id, user_id, ts, event_type AS kind, CAST(floor(value * 10) AS BIGINT) AS seconds, props FROM events)"""
