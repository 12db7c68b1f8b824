"""Queries over documents and their blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelab.operators import documents as ops
from quirelab.operators import revisions
from quirelab.plans.model import BLOCKS, blocks
from quirelab.plans.registry import query
from quirelab.session import table
from quirelab.sources import html



@query(f"WITH {BLOCKS} SELECT doc_id, section, position, kind, length(text) AS n FROM blocks")
def flatten_blocks(spark, sf):
    return blocks(spark, sf).select("doc_id", "section", "position", "kind", F.length("text").cast("long").alias("n"))


@query(f"WITH {BLOCKS} SELECT doc_id, position, CASE WHEN kind = 'paragraph' THEN CAST(sum(CASE WHEN kind = 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY position) AS BIGINT) END AS ordinal FROM blocks")
def paragraph_ordinals(spark, sf):
    return ops.paragraph_ordinals(blocks(spark, sf)).select("doc_id", "position", "ordinal")


@query(f"WITH {BLOCKS}, k AS (SELECT doc_id, position, kind, row_number() OVER (PARTITION BY doc_id, section, kind ORDER BY position) AS ordinal FROM blocks) SELECT doc_id, position, substr(kind, 1, 1) || ordinal AS code FROM k")
def type_ordinals(spark, sf):
    w = Window.partitionBy("doc_id", "section", "kind").orderBy("position")
    return blocks(spark, sf).select("doc_id", "position", F.concat(F.substring("kind", 1, 1), F.row_number().over(w).cast("string")).alias("code"))


@query()
def stable_ids(spark, sf):
    return ops.block_ids(blocks(spark, sf)).select("doc_id", "position", "block_id")


@query(f"WITH {BLOCKS} SELECT doc_id, section, arg_min(text, position) AS heading FROM blocks WHERE kind = 'heading' GROUP BY doc_id, section")
def first_headings(spark, sf):
    return ops.first_heading(blocks(spark, sf))


@query(f"WITH {BLOCKS}, s AS (SELECT doc_id, section, bool_and(length(text) % 5 <> 0) AS done FROM blocks GROUP BY doc_id, section), r AS (SELECT *, min(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section) AS run FROM s) SELECT doc_id, max(CASE WHEN run = 1 THEN section END) AS readable_upto FROM r GROUP BY doc_id")
def readable_prefix(spark, sf):
    sections = blocks(spark, sf).groupBy("doc_id", "section").agg(F.bool_and(F.length("text") % 5 != 0).alias("done"))
    return ops.readable_prefix(sections)


@query(f"WITH {BLOCKS} SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE length(text) % 3 <> 0) AS done, CASE WHEN count(*) = 0 THEN 100 ELSE least(100, CAST(floor(count(*) FILTER (WHERE length(text) % 3 <> 0) * 100 / count(*)) AS BIGINT)) END AS percent, CASE WHEN count(*) FILTER (WHERE length(text) % 3 <> 0) = 0 THEN 'pending' WHEN count(*) FILTER (WHERE length(text) % 3 <> 0) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM blocks WHERE kind <> 'figure' GROUP BY doc_id")
def progress_percent(spark, sf):
    done = F.count_if(F.length("text") % 3 != 0)
    rows = blocks(spark, sf).where("kind <> 'figure'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), done.alias("done"))
    status = F.when(F.col("done") == 0, "pending").when(F.col("done") == F.col("total"), "complete").otherwise("partial")
    return rows.select("doc_id", "total", "done", ops.progress_percent(F.col("done"), F.col("total")).alias("percent"), status.alias("status"))


@query(f"WITH {BLOCKS}, c AS (SELECT doc_id, coalesce(sum(length(text)) FILTER (WHERE kind = 'paragraph'), 0) AS a, coalesce(sum(length(text)) FILTER (WHERE kind <> 'paragraph'), 0) AS b, count(*) FILTER (WHERE kind = 'paragraph') AS p, count(*) FILTER (WHERE kind = 'heading' AND length(text) < 80) AS h FROM blocks GROUP BY doc_id) SELECT doc_id, CASE WHEN a + b >= 1000 AND a < (a + b) * 0.35 THEN 'short' WHEN p < 2 AND h = 0 THEN 'bare' ELSE 'accepted' END AS verdict FROM c")
def completeness(spark, sf):
    chars = lambda test: F.coalesce(F.sum(F.when(test, F.length("text"))), F.lit(0))
    paragraph = F.col("kind") == "paragraph"
    rows = blocks(spark, sf).groupBy("doc_id").agg(chars(paragraph).alias("a"), chars(~paragraph).alias("b"), F.count_if(paragraph).alias("p"), F.count_if((F.col("kind") == "heading") & (F.length("text") < 80)).alias("h"))
    return rows.select("doc_id", ops.completeness(F.col("a"), F.col("b"), F.col("p"), F.col("h")).alias("verdict"))


_NUMBERS = "array_to_string(list_sort(regexp_extract_all(replace({0}, ',', ''), '[0-9]+')), ' ')"


@query(
    f"""WITH p AS (SELECT a.doc_id, a.text AS s, b.text AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, array_to_string(list_filter([CASE WHEN {_NUMBERS.format("s")} <> {_NUMBERS.format("t")} THEN 'number_mismatch' END, CASE WHEN length(s) >= 60 AND NOT (length(t) / length(s) BETWEEN 0.30 AND 1.10) THEN 'length_outlier' END, CASE WHEN s = t AND length(s) > 0 THEN 'untranslated' END], lambda x: x IS NOT NULL), ',') AS flags FROM p"""
)
def quality_flags(spark, sf):
    d = table(spark, sf, "documents")
    pairs = d.select("doc_id", F.col("text").alias("s")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t")), "doc_id")
    return pairs.select("doc_id", F.array_join(ops.quality_flags(F.col("s"), F.col("t")), ",").alias("flags"))


@query("WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), a AS (SELECT doc_id, token, count(*) AS a FROM t WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT doc_id - 1 AS doc_id, token, count(*) AS b FROM t WHERE doc_id % 2 = 1 GROUP BY ALL) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.token, b.token) AS token, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.token = b.token WHERE coalesce(a, 0) <> coalesce(b, 0)")
def token_bag_difference(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return ops.token_bag_difference(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1), "doc_id")


@query(f"WITH {BLOCKS}, p AS (SELECT doc_id, count(DISTINCT section) AS n FROM blocks GROUP BY doc_id) SELECT b.doc_id, b.text, count(DISTINCT section) AS pages FROM blocks b JOIN p USING (doc_id) GROUP BY b.doc_id, b.text, n HAVING count(DISTINCT section) >= ceil(n * 0.6)")
def repeated_lines(spark, sf):
    return ops.repeated_lines(blocks(spark, sf), "doc_id", "section", "text")


_TWO = f"""{BLOCKS}, old AS (SELECT doc_id, position, text FROM blocks WHERE position % 9 <> 5), new AS (SELECT doc_id, position, CASE WHEN position % 11 = 4 THEN text || '!' ELSE text END AS text FROM blocks WHERE position % 8 <> 7)"""


def _revisions(spark, sf):
    b = blocks(spark, sf).select("doc_id", "position", "text")
    return b.where("position % 9 <> 5"), b.where("position % 8 <> 7").withColumn("text", F.when(F.col("position") % 11 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query(f"WITH {_TWO}, d AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.doc_id = n.doc_id AND o.position = n.position) SELECT doc_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM d GROUP BY doc_id")
def revision_diff(spark, sf):
    old, new = _revisions(spark, sf)
    changes = ops.revision_diff(old, new, ["doc_id", "position"], "text")
    return changes.groupBy("doc_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")))


@query()
def aligned_revisions(spark, sf):
    """Changes of each document between two revisions in which some blocks also moved down by six places. Tests hold the
    alignment against the longest common subsequence."""
    old, new = _revisions(spark, sf)
    at = F.col("position")
    place = F.when(at % 10 == 3, at * 10 + 65).otherwise(at * 10)
    old, new = (side.withColumn("block", at) for side in (old, new))
    return revisions.aligned_diff(old, new.withColumn("position", place), "doc_id", "block", "text")


@query(f"WITH {_TWO}, a AS (SELECT doc_id, text, min(position) AS old_position FROM old GROUP BY doc_id, text HAVING count(*) = 1), b AS (SELECT doc_id, text, min(position) AS new_position FROM new GROUP BY doc_id, text HAVING count(*) = 1) SELECT doc_id, old_position, new_position FROM a JOIN b USING (doc_id, text)")
def unique_hash_matches(spark, sf):
    return ops.unique_matches(*_revisions(spark, sf), "doc_id", "text").select("doc_id", "old_position", "new_position")


def _arrays(spark, sf):
    gather = lambda rows, name: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias(name))
    old, new = _revisions(spark, sf)
    return gather(old, "old").join(gather(new, "new"), "doc_id")


@query()
def carry_over(spark, sf):
    return ops.carry_over(_arrays(spark, sf)).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


@query()
def sequence_diff(spark, sf):
    texts = lambda c: F.transform(c, lambda x: x["text"])
    return ops.sequence_diff(_arrays(spark, sf).select("doc_id", texts("old").alias("old"), texts("new").alias("new")))


@query("SELECT d.doc_id, b.item_id, CAST(instr(d.text, b.text) AS BIGINT) AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_containment(spark, sf):
    return ops.contained_quotes(table(spark, sf, "benchmark").withColumnRenamed("text", "quote"), "item_id", "quote", table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query()
def fuzzy_duplicates(spark, sf):
    """Documents whose first lines are alike, from one source, as titles of one author."""
    d = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source", F.lit(2020).alias("year"))
    return ops.fuzzy_duplicates(d, "doc_id", "title", "source", "year")


@query(
    """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', '') AS host, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
 k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref'))) AS kept FROM u)
 SELECT page_id, scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normal, host FROM k"""
)
def url_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", ops.normalised_url(F.col("url")).alias("normal"), ops.url_host(F.col("url")).alias("host"))


@query("WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.GitHub.com/o/r' WHEN 1 THEN 'https://youtu.be/x' WHEN 2 THEN 'https://m.youtube.com/live/1' WHEN 3 THEN 'https://a.org/b.PDF' ELSE url END AS u FROM pages) SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'youtube' WHEN 2 THEN 'youtube' WHEN 3 THEN 'slides' ELSE 'article' END AS kind FROM x")
def url_kind(spark, sf):
    u = F.when(F.col("page_id") % 5 < 4, F.expr("try_element_at(array('https://www.GitHub.com/o/r', 'https://youtu.be/x', 'https://m.youtube.com/live/1', 'https://a.org/b.PDF'), cast(page_id % 5 + 1 as int))")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", ops.url_kind(u).alias("kind"))


@query("WITH r AS (SELECT item_id, 'A. Author (' || (1990 + item_id % 30) || '). \"' || substr(text, 1, 20) || '\". arXiv:2101.' || lpad(CAST(item_id AS VARCHAR), 5, '0') || 'v2, doi 10.1000/x' || item_id || '.' AS ref FROM benchmark) SELECT item_id, '2101.' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS arxiv_id, '10.1000/x' || item_id AS doi, CAST(1990 + item_id % 30 AS INTEGER) AS year FROM r")
def reference_fields(spark, sf):
    i = F.col("item_id")
    ref = F.concat(F.lit("A. Author ("), (1990 + i % 30).cast("string"), F.lit('). "'), F.substring("text", 1, 20), F.lit('". arXiv:2101.'), F.lpad(i.cast("string"), 5, "0"), F.lit("v2, doi 10.1000/x"), i.cast("string"), F.lit("."))
    f = ops.reference_fields(ref)
    return table(spark, sf, "benchmark").select("item_id", f["arxiv_id"].alias("arxiv_id"), f["doi"].alias("doi"), f["year"].alias("year"))


@query(
    f"""WITH RECURSIVE {BLOCKS}, t AS (SELECT doc_id, position, CAST(ceil(length(text) / 4 * 1.1) AS INTEGER) AS tokens FROM blocks),
 g(doc_id, position, batch, n, total) AS (SELECT doc_id, position, 0, 1, tokens FROM t WHERE position = 0 UNION ALL
  SELECT t.doc_id, t.position, CASE WHEN g.n >= 8 OR g.total + t.tokens > 2800 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.n >= 8 OR g.total + t.tokens > 2800 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 8 OR g.total + t.tokens > 2800 THEN t.tokens ELSE g.total + t.tokens END
  FROM g JOIN t ON t.doc_id = g.doc_id AND t.position = g.position + 1) SELECT doc_id, position, batch FROM g"""
)
def greedy_batches(spark, sf):
    return ops.greedy_batches(blocks(spark, sf))


@query("WITH m AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER w AS total, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, n FROM m WHERE total <= 1500 OR k = 1")
def budget_cut(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return ops.budget_cut(c, "conv_id", "turn", "n", 1500)


_TERMS = "terms AS (SELECT p_name AS term, p_brand AS translation, CASE p_partkey % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'user' ELSE 'global' END AS scope, p_partkey AS id FROM part)"


@query(f"WITH {_TERMS}, r AS (SELECT lower(term) AS term, translation, scope, row_number() OVER (PARTITION BY lower(term) ORDER BY CASE scope WHEN 'paper' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, id) AS k FROM terms) SELECT term, translation, scope FROM r WHERE k = 1")
def glossary_merge(spark, sf):
    p = table(spark, sf, "part")
    scope = F.when(F.col("p_partkey") % 3 == 0, "paper").when(F.col("p_partkey") % 3 == 1, "user").otherwise("global")
    return ops.glossary(p.select(F.col("p_name").alias("term"), F.col("p_brand").alias("translation"), scope.alias("scope"), F.col("p_partkey").alias("id")))


@query(f"WITH {_TERMS}, s AS (SELECT term, scope, translation, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN scope = 'user' THEN 0 ELSE 1 END, id) AS k FROM terms WHERE scope <> 'paper') SELECT term, translation, scope FROM s WHERE k = 1")
def overlay_priority(spark, sf):
    """Personal rows before shared ones."""
    p = table(spark, sf, "part").where("p_partkey % 3 <> 0")
    personal = F.col("p_partkey") % 3 == 1
    best = p.groupBy(F.col("p_name").alias("term")).agg(F.min_by(F.struct(F.col("p_brand").alias("translation"), F.when(personal, "user").otherwise("global").alias("scope")), F.struct(~personal, F.col("p_partkey"))).alias("x"))
    return best.select("term", "x.*")


@query(f"WITH {BLOCKS}, a AS (SELECT doc_id, position AS at FROM blocks WHERE position % 10 = 6) SELECT DISTINCT b.doc_id, b.position FROM blocks b JOIN a ON a.doc_id = b.doc_id AND abs(b.position - a.at) <= 2")
def blocks_near_anchors(spark, sf):
    """Range lookup as an equi join: each anchor is dealt to the five positions that it reaches."""
    b = blocks(spark, sf)
    reach = b.where("position % 10 = 6").select("doc_id", F.explode(F.sequence(F.col("position") - 2, F.col("position") + 2)).alias("position")).distinct()
    return b.join(reach, ["doc_id", "position"]).select("doc_id", "position")


@query(f"WITH {BLOCKS}, s AS (SELECT doc_id, position, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS r, section, max(section) OVER (PARTITION BY doc_id) AS last FROM blocks) SELECT doc_id, position, CAST(100 * r // n AS BIGINT) AS progress, r >= 0.9 * n AND section = last AS reached_end FROM s")
def reading_progress(spark, sf):
    w = Window.partitionBy("doc_id")
    r, n = F.row_number().over(w.orderBy("position")), F.count(F.lit(1)).over(w)
    return blocks(spark, sf).select("doc_id", "position", F.floor(100 * r / n).cast("long").alias("progress"), ((r >= 0.9 * n) & (F.col("section") == F.max("section").over(w))).alias("reached_end"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')) AS n FROM documents")
def sanitised_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(ops.sanitised(F.col("text"))).cast("long").alias("n"))


@query()
def html_blocks(spark, sf):
    return html.parse_pages(table(spark, sf, "pages")).select("page_id", "position", "kind", "section", F.length("text").alias("n"))
