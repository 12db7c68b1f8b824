"""Queries of smaller operators: plain texts, choices, boxes, evidence, progress, sort keys, the library's CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.operators import anchors, documents, layout, library, search, texts, timeseries, views
from quirelab.plans.layout import LINES, lines
from quirelab.plans.model import BLOCKS, ITEMS, PAPERS, PRIORITY_RANK, SESSIONS, blocks, choose, items, papers, sessions
from quirelab.plans.registry import query
from quirelab.session import table
from quirelab.sources import exports

_PAIRS = f"{BLOCKS}, pairs AS (SELECT x.doc_id, x.position AS a, y.position AS b, (length(x.text) * 7 + length(y.text) * 3) % 11 AS score FROM blocks x JOIN blocks y ON y.doc_id = x.doc_id AND y.position // 2 = x.position // 2)"


@query(
    f"WITH {_PAIRS}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a // 2 ORDER BY score DESC, a, b) AS k FROM pairs), f AS (SELECT * FROM g WHERE k = 1) SELECT doc_id, a, b, score FROM f UNION ALL SELECT p.doc_id, p.a, p.b, p.score FROM pairs p JOIN f ON f.doc_id = p.doc_id AND f.a // 2 = p.a // 2 AND f.a <> p.a AND f.b <> p.b"
)
def best_assignments(spark, sf):
    """Neighbouring blocks two by two: the best pair, then what it leaves."""
    b = blocks(spark, sf).select("doc_id", F.col("position").alias("a"), F.floor(F.col("position") / 2).alias("g"), F.length("text").alias("n"))
    other = b.select("doc_id", F.col("a").alias("b"), "g", F.col("n").alias("m"))
    pairs = b.join(other, ["doc_id", "g"]).select("doc_id", "a", "b", ((F.col("n") * 7 + F.col("m") * 3) % 11).alias("score"))
    return anchors.assigned_pairs(pairs)


@query(f"WITH {BLOCKS}, r AS (SELECT doc_id, section, position, kind, row_number() OVER (PARTITION BY doc_id, section, kind ORDER BY length(text) DESC, position) AS k FROM blocks) SELECT doc_id, section, position, kind FROM r WHERE k = 1")
def first_spans(spark, sf):
    return library.best_per_key(blocks(spark, sf), ["doc_id", "section", "kind"], [F.length("text").desc(), F.col("position")]).select("doc_id", "section", "position", "kind")


@query(f"WITH {BLOCKS} SELECT doc_id, position, trim(regexp_replace(CASE kind WHEN 'heading' THEN section || ' ' || text WHEN 'figure' THEN 'Figure  ' || position ELSE text || '  .' END, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) AS plain FROM blocks")
def plain_blocks(spark, sf):
    number, text = F.col("section").cast("string"), F.col("text")
    plain = documents.block_text(F.col("kind"), number, text, F.concat(text, F.lit("  .")), F.concat(F.lit("Figure  "), F.col("position").cast("string")))
    return blocks(spark, sf).select("doc_id", "position", plain.alias("plain"))


@query(
    """WITH m AS (SELECT item_id, '## ' || item_id || chr(10) || '> **' || text || '** [more](http://a.b/' || item_id || ')' || chr(10) || '- `x_1` ![p](q)' AS t FROM benchmark)
 SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^\\s{0,3}#{1,6}\\s*', '', 'g'), '(?m)^\\s{0,3}>\\s?', '', 'g'), '(?m)^\\s*[-*+]\\s+', '', 'g'), '[*_`~]', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM m"""
)
def stripped_markdown(spark, sf):
    i = F.col("item_id").cast("string")
    marked = F.concat(F.lit("## "), i, F.lit("\n> **"), F.col("text"), F.lit("** [more](http://a.b/"), i, F.lit(")\n- `x_1` ![p](q)"))
    return table(spark, sf, "benchmark").select("item_id", documents.without_markdown(marked).alias("plain"))


@query(
    f"WITH {LINES} SELECT doc_id, position, (size >= 10.4 OR position % 3 = 0) AND position % 2 = 0 OR position % 10 = 5 AS heading FROM plines"
)
def heading_lines(spark, sf):
    """Lines of which every second is numbered, and some are headings by their word."""
    p = F.col("position")
    text = F.when(p % 10 == 5, "3 Results").when(p % 2 == 0, F.concat(F.lit("2.1 x "), F.col("text"))).otherwise(F.concat(F.lit("x "), F.col("text")))
    return lines(spark, sf).select("doc_id", "position", layout.is_heading(text, F.col("size"), F.lit(9.0), p % 3 == 0).alias("heading"))


@query(f"WITH {LINES}, v AS (SELECT doc_id, position, x, regexp_replace(text, '[ \\t\\n\\f\\r\\x0B]', '', 'g') || '=(1)' AS t FROM plines) SELECT doc_id, position, x = 50 AND len(regexp_extract_all(t, '[-=+*/^_<>()\\[\\]{{}}|0-9∑∏∫√≤≥≈∈∀∃αβγδθλμπσω]')) * 4 >= length(t) AS equation FROM v")
def equation_lines(spark, sf):
    text = F.concat(F.col("text"), F.lit(" = (1)"))
    return lines(spark, sf).select("doc_id", "position", layout.is_display_equation(text, F.col("x"), F.col("x") + 500, F.lit(300)).alias("equation"))


@query(
    "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y FROM lineitem), p AS (SELECT u.page, u.n AS a, v.n AS b, greatest(0, least(u.x, v.x) + 20 - greatest(u.x, v.x)) * greatest(0, least(u.y, v.y) + 10 - greatest(u.y, v.y)) AS c FROM b u JOIN b v ON u.page = v.page AND u.n < v.n) SELECT page, a, b, round(c / (400 - c), 6) AS iou FROM p WHERE c > 0"
)
def box_overlaps(spark, sf):
    """Boxes of 20 by 10 points on one page that overlap."""
    li = table(spark, sf, "lineitem")
    box = lambda k: li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias(f"n{k}"), F.col("l_quantity").cast("double").alias(f"x{k}"), (F.col("l_suppkey") % 50).cast("double").alias(f"y{k}"))
    pairs = box(0).join(box(1), "page").where("n0 < n1")
    corners = lambda k: [F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"x{k}") + 20, F.col(f"y{k}") + 10]
    iou = layout.intersection_over_union(corners(0), corners(1))
    return pairs.select("page", F.col("n0").alias("a"), F.col("n1").alias("b"), F.round(iou, 6).alias("iou")).where("iou > 0")


@query(
    "WITH k AS (SELECT l_orderkey AS id, list_distinct(list(l_linenumber)) AS known, [3, 9, 1, 3, l_orderkey % 7] AS asked FROM lineitem GROUP BY l_orderkey) SELECT id, CASE WHEN list_contains(known, 3) THEN '3,' ELSE '' END || CASE WHEN list_contains(known, 1) THEN '1,' ELSE '' END || CASE WHEN id % 7 NOT IN (1, 3) AND list_contains(known, id % 7) THEN (id % 7) || ',' ELSE '' END AS evidence FROM k"
)
def evidence_known(spark, sf):
    known = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("known"))
    asked = F.array(*(F.lit(n).cast("long") for n in (3, 9, 1, 3)), F.col("id") % 7)
    kept = anchors.known_evidence(asked, F.col("known"))
    return known.select("id", F.array_join(F.transform(kept, lambda i: F.concat(i.cast("string"), F.lit(","))), "").alias("evidence"))


@query(f"WITH {BLOCKS}, p AS (SELECT doc_id, string_agg(kind || ':' || text || ':Section ' || section, chr(10) ORDER BY position) AS article FROM blocks WHERE kind <> 'figure' GROUP BY doc_id) SELECT d.doc_id, coalesce(article, '') AS article FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN p USING (doc_id)")
def published_articles(spark, sf):
    """Blocks of an article without figures; of their evidence only the titles."""
    evidence = F.array(F.struct(F.concat(F.lit("Section "), F.col("section").cast("string")).alias("title"), F.col("text").alias("quote")))
    whole = blocks(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "text", evidence.alias("evidence")))).alias("b"))
    kept = views.published(F.col("b"), ("heading", "paragraph"))
    return whole.select("doc_id", F.array_join(F.transform(kept, lambda b: F.concat_ws(":", b["kind"], b["text"], F.array_join(b["evidence"], ","))), "\n").alias("article"))


@query(f"WITH {SESSIONS} SELECT event_id, CASE kind WHEN 'view' THEN 5 WHEN 'click' THEN 20 WHEN 'signup' THEN 80 WHEN 'purchase' THEN 100 END AS progress FROM sessions")
def job_progress(spark, sf):
    stage = choose(F.col("kind"), {"view": "fetching", "click": "parsing", "signup": "body", "purchase": "complete", "error": "unknown"})
    return sessions(spark, sf).select("event_id", timeseries.stage_progress(stage).alias("progress"))


@query("WITH m AS (SELECT doc_id, length(text) % 3 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN '機械|械学|学習' WHEN 1 THEN '深層|とは' ELSE '' END AS pairs FROM m")
def character_pairs(spark, sf):
    """Pairs of characters that a text in a script without spaces is searched by."""
    kind = F.length("text") % 3
    text = F.concat(F.when(kind == 0, "機械学習 of ").when(kind == 1, "深層、a とは ").otherwise("字 "), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.array_join(texts.bigrams(F.coalesce(text, F.when(kind == 0, "機械学習").when(kind == 1, "深層、とは").otherwise("字"))), "|"), F.lit("")).alias("pairs"))


@query("SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'))) BETWEEN 1 AND 200 THEN trim(regexp_replace(text, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) END AS asked FROM documents")
def queries_normalised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", search.normalised_queries(F.col("text")).alias("asked"))


@query("WITH q AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'A' END AS quality FROM orders) SELECT value, CAST(count(quality) AS BIGINT) AS n FROM (VALUES ('A'), ('B')) v(value) LEFT JOIN q ON quality = value GROUP BY value")
def facet_quality(spark, sf):
    """Both grades, B with no row."""
    graded = items(spark, sf).select(F.when(F.col("item_id") % 4 == 0, "A").alias("quality"))
    return library.facet(graded, "quality", ["A", "B"])


_KEYS = {"updated_at": "date_add(added_on, CAST(item_id % 9 AS INT))", "added_at": "added_on", "title": "title", "deadline": "deadline", "priority": "rank", "reading_time": "item_id % 97", "comprehension": "nullif(item_id % 5, 0)"}
_SORTED = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS sort, {str(down).lower()} AS descending, CAST(row_number() OVER (ORDER BY {key} {d} NULLS LAST, item_id {d}) AS INTEGER) AS place, item_id FROM s) WHERE place <= 15"
    for name, k in _KEYS.items()
    for key in (k.replace("date_add(added_on, CAST(item_id % 9 AS INT))", "added_on + CAST(item_id % 9 AS INTEGER)"),)
    for down, d in ((False, "ASC"), (True, "DESC"))
)


@query(f"WITH {ITEMS}, {PAPERS}, s AS (SELECT items.*, title, CASE priority WHEN 'high' THEN 0 WHEN 'mid' THEN 1 WHEN 'low' THEN 2 END AS rank FROM items LEFT JOIN papers USING (paper_id)) {_SORTED}")
def sort_keys(spark, sf):
    """The first rows by each of the seven keys, both ways."""
    rows = items(spark, sf).join(papers(spark, sf).select("paper_id", "title"), "paper_id", "left").withColumn("rank", choose(F.col("priority"), PRIORITY_RANK))
    return library.sorted_heads(rows, {k: F.expr(v) for k, v in _KEYS.items()}, "item_id", 15)


@query(
    f"WITH {LINES}, m AS (SELECT doc_id, position AS paragraph, page, CASE WHEN position % 4 = 0 THEN 'and ' || text ELSE 'The ' || text || '.' END AS text FROM plines), f AS (SELECT *, CASE WHEN lag(page) OVER w <> page AND paragraph % 4 = 0 AND NOT regexp_matches(lag(text) OVER w, '[.!?:。！？]\\s*$') THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph)) SELECT doc_id, paragraph, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY paragraph) - 1 AS BIGINT) AS merged FROM (SELECT doc_id, paragraph, fresh FROM f)"
)
def paragraphs_over_pages(spark, sf):
    p = F.col("position")
    text = F.when(p % 4 == 0, F.concat(F.lit("and "), F.col("text"))).otherwise(F.concat(F.lit("The "), F.col("text"), F.lit(".")))
    return layout.continued_paragraphs(lines(spark, sf).select("doc_id", p.alias("paragraph"), "page", text.alias("text"))).select("doc_id", "paragraph", "merged")


@query(
    f"""WITH {ITEMS}, {PAPERS} SELECT coalesce(title, '') AS title, coalesce(array_to_string(tags, '; '), '') AS authors, coalesce(CAST(year AS VARCHAR), '') AS year, coalesce(brand, '') AS venue, '' AS arxiv_id, '' AS doi, status, coalesce(priority, '') AS priority, coalesce(CAST(deadline AS VARCHAR), '') AS deadline, coalesce(array_to_string(tags[:2], '; '), '') AS tags,
 CASE WHEN item_id % 4 = 0 THEN 'A' ELSE 'B' END AS quality, CAST(added_on AS VARCHAR) AS added_at, CASE WHEN status = 'done' THEN CAST(added_on AS VARCHAR) ELSE '' END AS finished_at, printf('%.2f', (item_id % 1000) * 36 / 3600.0) AS reading_hours, CAST(item_id % 5 AS VARCHAR) AS comprehension, '' AS importance FROM items LEFT JOIN papers USING (paper_id)"""
)
def library_csv(spark, sf):
    """All columns of the library's CSV."""
    i = F.col("item_id")
    rows = items(spark, sf).join(papers(spark, sf).drop("kind"), "paper_id", "left")
    rows = rows.select(
        "title", F.col("tags").alias("authors"), "year", F.col("brand").alias("venue"), "status", "priority", "deadline", F.slice("tags", 1, 2).alias("tags"),
        F.when(i % 4 == 0, "A").otherwise("B").alias("quality"), F.col("added_on").alias("added_at"), F.when(F.col("status") == "done", F.col("added_on")).alias("finished_at"),
        ((i % 1000) * 36).alias("seconds"), (i % 5).alias("comprehension"),
    )
    return exports.library_csv(rows)


_BOXES = f"""{BLOCKS}, boxes AS (SELECT doc_id, position, CAST(position // 12 AS INTEGER) AS page, CASE WHEN position % 12 = 0 OR position % 36 > 30 THEN 60.0 WHEN position % 12 < 7 THEN 50.0 ELSE 310.0 END AS x0, CASE WHEN position % 12 = 0 OR position % 36 > 30 THEN 540.0 WHEN position % 12 < 7 THEN 290.0 ELSE 550.0 END AS x1,
 CASE WHEN position % 12 = 0 THEN 40.0 ELSE 60.0 + (position % 12 % 6) * 14 END AS y0, text FROM blocks)"""


def _boxes(spark, sf):
    """Blocks as lines of two columns with one line over both; every third page has lines across the middle."""
    p = F.col("position")
    across, left = (p % 12 == 0) | (p % 36 > 30), p % 12 < 7
    y0 = F.when(p % 12 == 0, 40.0).otherwise(60.0 + (p % 12 % 6) * 14)
    found = blocks(spark, sf).select("doc_id", "position", F.floor(p / 12).cast("int").alias("page"), F.when(across, 60.0).when(left, 50.0).otherwise(310.0).alias("x0"), F.when(across, 540.0).when(left, 290.0).otherwise(550.0).alias("x1"), y0.alias("y0"), "text")
    return found.withColumns({"y1": F.col("y0") + 12, "width": F.lit(600.0), "height": F.lit(800.0)})


@query(
    f"""WITH {_BOXES}, c AS (SELECT *, x0 < 228 AND x1 > 372 AS crossing, (x0 + x1) / 2 >= 300 AS r FROM boxes), w AS (SELECT *, avg(CASE WHEN crossing THEN 0.0 ELSE 1.0 END) OVER p AS share, min(CASE WHEN NOT crossing AND r THEN x0 END) OVER p - max(CASE WHEN NOT crossing AND NOT r THEN x1 END) OVER p AS gutter, min(CASE WHEN NOT crossing THEN y0 END) OVER p AS top FROM c WINDOW p AS (PARTITION BY doc_id, page)),
 t AS (SELECT *, coalesce(share >= 0.85 AND gutter >= 16, false) AS two FROM w), o AS (SELECT *, CASE WHEN NOT two THEN 0 WHEN crossing THEN CASE WHEN y0 + 12 <= top THEN 0 ELSE 3 END WHEN r THEN 2 ELSE 1 END AS part FROM t)
 SELECT doc_id, position, two AS two_columns, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, part, y0, x0, position) AS INTEGER) AS "order" FROM o"""
)
def column_order(spark, sf):
    return layout.column_order(_boxes(spark, sf)).select("doc_id", "position", "two_columns", "order")


@query(
    f"""WITH {_BOXES}, l AS (SELECT doc_id, position, page, y0, CASE WHEN position % 12 = 0 THEN 'Page  ' || page || ' of a journal' WHEN position % 12 = 5 THEN CAST(page AS VARCHAR) ELSE text END AS t FROM boxes), b AS (SELECT *, y0 = 40 OR position % 12 = 5 AS band FROM l), s AS (SELECT *, CASE WHEN band AND NOT regexp_matches(trim(t), '^[0-9]{{1,4}}$') THEN regexp_replace(trim(regexp_replace(t, '[ \t\n]+', ' ', 'g')), '[0-9]', '#', 'g') END AS same FROM b),
 n AS (SELECT doc_id, same, count(DISTINCT page) AS n FROM s WHERE same <> '' GROUP BY doc_id, same), a AS (SELECT doc_id, count(DISTINCT page) AS a FROM s GROUP BY doc_id) SELECT s.doc_id, position, coalesce(band AND regexp_matches(trim(t), '^[0-9]{{1,4}}$') OR n.n * 10 >= a.a * 6, false) AS running FROM s JOIN a USING (doc_id) LEFT JOIN n ON n.doc_id = s.doc_id AND n.same = s.same"""
)
def running_lines(spark, sf):
    """Lines with a running title above and a page number below."""
    p, page = F.col("position"), F.col("page").cast("string")
    text = F.when(p % 12 == 0, F.concat(F.lit("Page  "), page, F.lit(" of a journal"))).when(p % 12 == 5, page).otherwise(F.col("text"))
    given = _boxes(spark, sf).withColumns({"text": text, "y0": F.when(p % 12 == 5, 770.0).otherwise(F.col("y0"))}).withColumn("y1", F.col("y0") + 12)
    return layout.running_lines(given, F.col("text")).select("doc_id", "position", "running")
