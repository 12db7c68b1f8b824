"""Queries of text statistics, grids, page positions and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.operators import texts as ops
from quirelab.plans.model import BLOCKS, blocks
from quirelab.plans.registry import query
from quirelab.session import table


@query("SELECT doc_id, greatest(1, CAST(ceil(len(regexp_extract_all(text, '[^\\s]+')) / 250) AS BIGINT)) AS minutes, CAST(ceil(length(text) / 4 * 1.1) AS BIGINT) AS tokens FROM documents")
def reading_minutes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.reading_minutes(F.col("text")).alias("minutes"), ops.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, round((n * 2.5 + m * 10.0) / 1000000, 8) AS cost FROM (SELECT event_id, user_id * 100 AS n, event_id % 500 AS m FROM events)")
def cost_estimate(spark, sf):
    return table(spark, sf, "events").select("event_id", ops.estimated_cost(F.col("user_id") * 100, F.col("event_id") % 500, "large").alias("cost"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (event_id % 5) * 3600 + (event_id % 60) * 60 + 7 END AS seconds FROM events")
def iso_durations(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 4 == 3, "PTX").otherwise(F.concat(F.lit("PT"), (i % 5).cast("string"), F.lit("H"), (i % 60).cast("string"), F.lit("M7S")))
    return table(spark, sf, "events").select("event_id", ops.iso_duration_seconds(text).alias("seconds"))


@query("WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark) SELECT token, CASE WHEN regexp_matches(token, '^[a-z]{3,}ies$') THEN regexp_replace(token, 'ies$', 'y') ELSE token END AS stem FROM t WHERE NOT regexp_matches(token, '(s|ing|ed)$') OR regexp_matches(token, '^[a-z]{3,}ies$')")
def stems(spark, sf):
    t = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("token")).distinct()
    return t.where("NOT token RLIKE '(s|ing|ed)$' OR token RLIKE '^[a-z]{3,}ies$'").select("token", ops.stemmed(F.col("token")).alias("stem"))


@query("SELECT page_id, CAST(r AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS \"column\", 'c' || page_id || '-' || r || c AS text FROM pages, range(2) a(r), range(3) b(c)")
def table_cells(spark, sf):
    i = F.col("page_id").cast("string")
    cell = lambda r, c: F.concat(F.lit("<td> c"), i, F.lit(f"-{r}{c}</td>"))
    html = F.concat(F.lit("<table><tr>"), *(cell(0, c) for c in range(3)), F.lit("</tr><tr>"), *(cell(1, c) for c in range(3)), F.lit("</tr></table>"))
    return ops.table_cells(table(spark, sf, "pages").select("page_id", html.alias("h")), "page_id", "h").select("page_id", "row", "column", "text")


@query("WITH f AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id AS id FROM f WHERE doc_id % 3 <> 0 AND doc_id % 4 + 1 <= n AND doc_id % 5 <> 0")
def verified_output(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    i = F.col("path")
    confidence = F.when(i % 5 == 0, "sure").otherwise("high")
    excerpt = F.when(i % 3 == 0, "~~~absent~~~").otherwise(F.substring("text", 1, 10))
    found = d.select(i.alias("id"), i.alias("path"), F.lit(1).alias("first_line"), (i % 4 + 1).alias("last_line"), excerpt.alias("excerpt"), confidence.alias("confidence"))
    return ops.verified_output(found.union(found.withColumn("id", F.col("id") + 1_000_000)), d).select("id")


@query(f"WITH {BLOCKS}, l AS (SELECT doc_id, position, text, length(text) % 4 AS size FROM blocks WHERE position < 10), u AS (SELECT * FROM l WHERE position / 10 <= 0.4), m AS (SELECT *, max(size) OVER (PARTITION BY doc_id) AS m FROM u) SELECT doc_id, string_agg(text, ' ' ORDER BY position) AS title FROM m WHERE size = m GROUP BY doc_id")
def bibliography_titles(spark, sf):
    lines = blocks(spark, sf).where("position < 10").select("doc_id", "position", (F.col("position") / 10).alias("y_share"), (F.length("text") % 4).alias("size"), "text")
    return ops.bibliography(lines).select("doc_id", "title")


@query(f"WITH {BLOCKS}, m AS (SELECT doc_id, position AS n, (position * 7) % 23 AS o FROM blocks), h AS (SELECT *, max(o) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM m) SELECT doc_id, n AS new_position, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS segment FROM h WHERE h IS NULL OR o > h")
def monotonic_segments(spark, sf):
    m = blocks(spark, sf).select("doc_id", F.col("position").alias("new_position"), ((F.col("position") * 7) % 23).alias("old_position"))
    return ops.monotonic_segments(m).select("doc_id", "new_position", F.col("segment").cast("long").alias("segment"))


@query()
def page_positions(spark, sf):
    b = blocks(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("blocks"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("blocks") - 1) / 5).cast("int")), lambda k: F.array_join(F.slice("blocks", k * 5 + 1, F.lit(5)), " "))
    return ops.page_positions(b.withColumn("pages", pages))
