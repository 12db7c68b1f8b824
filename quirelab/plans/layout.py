"""Queries over lines of pages, anchors, scope and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelab.operators import anchors, documents, layout, threads
from quirelab.plans.model import BLOCKS, blocks
from quirelab.plans.registry import query
from quirelab.session import table

LINES = f"""{BLOCKS}, plines AS (SELECT doc_id, position, CAST(position // 10 AS INTEGER) AS page, CAST((position % 10) * 14 + 40 AS DOUBLE) AS y, CASE WHEN length(text) % 2 = 0 THEN 50.0 ELSE 310.0 END AS x, 9.0 + length(text) % 3 AS size, text FROM blocks)"""


def lines(spark, sf):
    """Blocks laid out as lines of pages: page, place, font size."""
    p = F.col("position")
    n = F.length("text")
    return blocks(spark, sf).select("doc_id", "position", F.floor(p / 10).cast("int").alias("page"), ((p % 10) * 14 + 40).cast("double").alias("y"), F.when(n % 2 == 0, 50.0).otherwise(310.0).alias("x"), (9.0 + n % 3).alias("size"), F.lit(12.0).alias("height"), "text")


@query(f"WITH {LINES}, s AS (SELECT doc_id, size, count(*) AS n, min(position) AS p FROM plines GROUP BY doc_id, size), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS k FROM s) SELECT doc_id, CAST(size AS DOUBLE) AS size FROM r WHERE k = 1")
def body_font_size(spark, sf):
    return layout.body_size(lines(spark, sf))


@query(f"WITH {BLOCKS}, r AS (SELECT doc_id, length(text) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks) SELECT doc_id, CAST(v AS INTEGER) AS median FROM r WHERE k = n // 2 + 1")
def upper_median_length(spark, sf):
    return layout.upper_median(blocks(spark, sf).withColumn("v", F.length("text")), "doc_id", "v")


@query(f"WITH {LINES}, c AS (SELECT *, avg(CASE WHEN x < 300 THEN 1.0 ELSE 0 END) OVER w AS l, avg(CASE WHEN x >= 300 THEN 1.0 ELSE 0 END) OVER w AS r FROM plines WINDOW w AS (PARTITION BY doc_id, page)), d AS (SELECT *, CASE WHEN l >= 1.0 / 3 AND r >= 1.0 / 3 AND x >= 300 THEN 1 ELSE 0 END AS col FROM c) SELECT doc_id, position, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, col, y, x, position) AS INTEGER) AS \"order\" FROM d")
def reading_order(spark, sf):
    return layout.reading_order(lines(spark, sf)).select("doc_id", "position", "order")


@query(
    f"""WITH {BLOCKS}, m AS (SELECT doc_id, position, CASE WHEN position % 3 = 0 THEN '[' || (position // 3 + 1) || '] ' || text ELSE text END AS text FROM blocks), n AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^\\s*(\\[[0-9]+\\]|[0-9]+\\.|\\([0-9]+\\))\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS reference FROM m),
 j AS (SELECT doc_id, reference, string_agg(text, chr(10) ORDER BY position) AS t FROM n GROUP BY doc_id, reference) SELECT doc_id, CAST(reference AS BIGINT) AS reference, trim(regexp_replace(regexp_replace(t, '(\\pL)-\\n(\\p{{Ll}})', '\\1\\2', 'g'), '\\s*\\n\\s*', ' ', 'g')) AS text FROM j"""
)
def reference_groups(spark, sf):
    p = F.col("position")
    marked = F.when(p % 3 == 0, F.concat(F.lit("["), (F.floor(p / 3) + 1).cast("string"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    return layout.grouped_references(blocks(spark, sf).select("doc_id", "position", marked.alias("text")))


@query(
    f"""WITH RECURSIVE {LINES}, g(doc_id, position, page, y, x0, paragraph) AS (SELECT doc_id, position, page, y, x, 0 FROM plines WHERE position = 0 UNION ALL
 SELECT l.doc_id, l.position, l.page, l.y, CASE WHEN l.page <> g.page OR NOT (l.y - g.y - 12 BETWEEN 0 AND 10.8) OR l.x - g.x0 > 8 THEN l.x ELSE g.x0 END, CASE WHEN l.page <> g.page OR NOT (l.y - g.y - 12 BETWEEN 0 AND 10.8) OR l.x - g.x0 > 8 THEN g.paragraph + 1 ELSE g.paragraph END
 FROM g JOIN plines l ON l.doc_id = g.doc_id AND l.position = g.position + 1) SELECT doc_id, max(paragraph) AS last FROM g GROUP BY doc_id"""
)
def line_paragraphs(spark, sf):
    return layout.paragraphs(lines(spark, sf)).groupBy("doc_id").agg(F.max("paragraph").alias("last"))


@query(f"WITH {BLOCKS}, f AS (SELECT doc_id, position, length(text) AS area, CASE WHEN position % 14 = 3 THEN '1' ELSE '2' END AS number FROM blocks WHERE kind = 'figure'), r AS (SELECT doc_id, position, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN number = '1' THEN 0 ELSE 1 END, area DESC, position) AS k FROM f) SELECT doc_id, position FROM r WHERE k = 1")
def thumbnail_choice(spark, sf):
    f = blocks(spark, sf).where("kind = 'figure'").select("doc_id", "position", F.length("text").alias("area"), F.when(F.col("position") % 14 == 3, "1").otherwise("2").alias("number"))
    return layout.thumbnail(f)


_NOTES = f"""{BLOCKS}, notes AS (SELECT doc_id * 1000000 + position AS note_id, doc_id, position, text AS quote FROM blocks WHERE position % 5 = 1), fresh AS (SELECT doc_id, position + CASE WHEN position % 5 = 1 AND position % 2 = 0 THEN 1000000 ELSE 0 END AS position, text FROM blocks WHERE NOT (position % 5 = 1 AND position % 3 = 0))"""


@query(f"WITH {_NOTES}, k AS (SELECT n.*, EXISTS (SELECT 1 FROM fresh f WHERE f.doc_id = n.doc_id AND f.position = n.position) AS alive FROM notes n), m AS (SELECT k.note_id, min(f.position) AS p FROM k JOIN fresh f ON f.doc_id = k.doc_id AND contains(f.text, k.quote) WHERE NOT alive AND quote <> '' GROUP BY k.note_id) SELECT note_id, doc_id, CASE WHEN alive THEN position ELSE m.p END AS block_id, CASE WHEN alive THEN 'kept' WHEN m.p IS NOT NULL THEN 'moved' ELSE 'orphaned' END AS how FROM k LEFT JOIN m USING (note_id)")
def reanchor(spark, sf):
    b, p = blocks(spark, sf), F.col("position")
    notes = b.where("position % 5 = 1").select((F.col("doc_id") * 1_000_000 + p).alias("note_id"), "doc_id", p.alias("block_id"), F.col("text").alias("quote"))
    fresh = b.where("NOT (position % 5 = 1 AND position % 3 = 0)").withColumn("position", p + F.when((p % 5 == 1) & (p % 2 == 0), 1_000_000).otherwise(0))
    return anchors.reanchor(notes, fresh.withColumn("block_id", F.col("position")))


@query(f"WITH {BLOCKS}, h AS (SELECT doc_id, section, CASE WHEN section % 6 = 4 THEN '5 References' WHEN section % 6 = 5 THEN 'Appendix A' ELSE arg_min(text, position) END AS heading FROM blocks WHERE kind = 'heading' GROUP BY doc_id, section), m AS (SELECT doc_id, section, lower(trim(regexp_replace(heading, '^[0-9.\\s]+', ''))) IN ('references', 'bibliography') AS refs, bool_or(regexp_matches(lower(trim(regexp_replace(heading, '^[0-9.\\s]+', ''))), '^appendix\\b') OR regexp_matches(heading, '^[A-H][.\\s]\\s*\\S')) OVER (PARTITION BY doc_id ORDER BY section) AS app FROM h) SELECT doc_id, position, CASE WHEN coalesce(refs, false) THEN 'none' WHEN coalesce(app, false) THEN 'appendix' ELSE 'body' END AS scope FROM blocks LEFT JOIN m USING (doc_id, section)")
def scope_blocks(spark, sf):
    b = blocks(spark, sf)
    s = F.col("section") % 6
    heads = documents.first_heading(b).withColumn("heading", F.when(s == 4, "5 References").when(s == 5, "Appendix A").otherwise(F.col("heading")))
    return anchors.in_scope(b, heads).select("doc_id", "position", "scope")


@query()
def placeholders(spark, sf):
    """Whole texts with formulas, code and citations put out of a translator's reach and back; tests hold it against a plain walk."""
    e = table(spark, sf, "documents").select("doc_id", "text", anchors.with_placeholders(F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e.text").alias("encoded"), F.size("e.values").alias("n"), (anchors.restored(F.col("e.text"), F.col("e.values")) == F.col("text")).alias("same"))


@query(rf"WITH {BLOCKS}, s AS (SELECT doc_id, position, CAST(2 * (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END) + len(list_distinct(regexp_extract_all(text, '\b([a-z]+(?:[A-Z][a-z0-9]+)+|[a-z0-9]+(?:_[a-z0-9]+)+)\b', 1))) AS INTEGER) AS score FROM blocks WHERE length(text) >= 40), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS k FROM s WHERE score > 0) SELECT doc_id, position, score FROM r WHERE k <= 30")
def claim_scores(spark, sf):
    return anchors.claims(blocks(spark, sf), ("the", "that"))


@query(
    f"""WITH RECURSIVE {BLOCKS}, s AS (SELECT doc_id, section, max(position) % 7 = 3 AS anchored, sum((length(text) - length(replace(text, 'that', ''))) // 4) AS matches, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM blocks GROUP BY doc_id, section),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anchored DESC, matches DESC, section) AS k FROM s),
 g(doc_id, k, section, rest, promoted) AS (SELECT doc_id, k, section, CASE WHEN tokens <= 400 THEN 400 - tokens ELSE 400 END, tokens <= 400 FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.section, CASE WHEN o.tokens <= g.rest THEN g.rest - o.tokens ELSE g.rest END, o.tokens <= g.rest FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1) SELECT doc_id, section, promoted FROM g"""
)
def promoted_sections(spark, sf):
    s = blocks(spark, sf).groupBy("doc_id", "section").agg((F.max("position") % 7 == 3).alias("anchored"), F.sum(F.regexp_count("text", F.lit("that"))).alias("matches"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
    return anchors.promoted_sections(s, 400)


@query()
def verified_quotes(spark, sf):
    """Whole items as quotes: from the item as it stands, with its end written anew, and from another item."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    other = b.select((F.col("id") - 1).alias("id"), F.col("text").alias("next"))
    end = (F.length("text") * 0.1).cast("int")
    quote = F.when(F.col("id") % 3 == 0, F.col("text")).when(F.col("id") % 3 == 1, F.concat(F.substring("text", F.lit(1), F.length("text") - end), F.repeat(F.lit("#"), end))).otherwise(F.col("next"))
    return anchors.verified_quotes(b.join(other, "id", "left").withColumn("quote", quote)).select("id", "how")


@query("WITH r AS (SELECT item_id AS ref_id, 'ARXIV.' || (item_id % 30) || 'v' || (item_id % 3 + 1) AS a FROM benchmark), p AS (SELECT p_partkey AS paper_id, 'arxiv.' || p_partkey AS a FROM part) SELECT ref_id, paper_id FROM r LEFT JOIN p ON regexp_replace(lower(r.a), 'v[0-9]+$', '') = p.a")
def citations_in_library(spark, sf):
    i = F.col("item_id")
    refs = table(spark, sf, "benchmark").select(i.alias("ref_id"), F.concat(F.lit("ARXIV."), (i % 30).cast("string"), F.lit("v"), (i % 3 + 1).cast("string")).alias("arxiv_id"))
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.concat(F.lit("arxiv."), F.col("p_partkey").cast("string")).alias("arxiv_id"))
    return anchors.reference_matches(refs, own).select("ref_id", "paper_id")


@query("WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, depth FROM t")
def comment_threads(spark, sf):
    """Depth in a thread in which each message answers the one before it."""
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return threads.threads(m, "conv_id", "turn", "parent").where("root = 0").select("conv_id", "turn", F.col("depth").cast("int").alias("depth"))


@query("WITH RECURSIVE m AS (SELECT o_custkey AS thread, o_orderkey AS message, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -1 ELSE lag(o_orderkey, CAST(1 + o_orderkey % 3 AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent FROM orders), t(thread, message, root, depth, how) AS (SELECT thread, message, message, CAST(0 AS BIGINT), CASE WHEN parent IS NULL THEN 'root' ELSE 'orphan' END FROM m WHERE parent IS NULL OR parent = -1 UNION ALL SELECT m.thread, m.message, t.root, t.depth + 1, 'reply' FROM m JOIN t ON t.thread = m.thread AND t.message = m.parent) SELECT thread, message, root, depth, how FROM t")
def comment_trees(spark, sf):
    """Threads in which a message answers one of the three before it, with roots and missing parents."""
    key = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.when(key % 3 == 0, F.lag("o_orderkey", 1).over(w)).when(key % 3 == 1, F.lag("o_orderkey", 2).over(w)).otherwise(F.lag("o_orderkey", 3).over(w))
    parent = F.when(key % 11 == 0, None).when(key % 13 == 0, -1).otherwise(before)
    return threads.threads(table(spark, sf, "orders").select(F.col("o_custkey").alias("thread"), key.alias("message"), parent.alias("parent")), "thread", "message", "parent")


@query(
    """WITH x AS (SELECT ps.p_partkey % 50 AS paper_id, CASE p_partkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'space' END AS kind, CAST(p_partkey % 3 AS INTEGER) AS kind_order, 'https://www.H.org/' || p_brand || '/' AS url, p_size AS rank_value, p_partkey AS position FROM part ps),
 a AS (SELECT *, row_number() OVER (PARTITION BY paper_id, kind ORDER BY rank_value DESC, position) AS k FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY paper_id, lower(url) ORDER BY kind_order, k) AS d FROM a WHERE k <= CASE kind WHEN 'model' THEN 5 ELSE 3 END), c AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY kind_order, k) AS place FROM b WHERE d = 1) SELECT paper_id, CAST(place AS INTEGER) AS place, position FROM c WHERE place <= 13"""
)
def resource_discovery(spark, sf):
    p = F.col("p_partkey")
    kind = F.when(p % 3 == 0, "model").when(p % 3 == 1, "dataset").otherwise("space")
    rows = table(spark, sf, "part").select((p % 50).alias("paper_id"), kind.alias("kind"), (p % 3).cast("int").alias("kind_order"), F.concat(F.lit("https://www.H.org/"), "p_brand", F.lit("/")).alias("url"), F.col("p_size").alias("rank_value"), p.alias("position"))
    return anchors.discovered(rows, {"model": 5, "dataset": 3, "space": 3}).select("paper_id", "place", "position")
