"""Queries of labels, policies, orders, selections and single-row transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.operators import views as ops
from quirelab.plans.model import BLOCKS, ITEMS, SESSIONS, blocks, items, sessions
from quirelab.plans.registry import query
from quirelab.session import table


@query("WITH l(id, embed, credit) AS (VALUES ('cc-by-4.0', 'allow', true), ('cc0', 'allow', false), ('unknown', 'link_card', true)) SELECT doc_id, embed, credit FROM documents JOIN l ON id = CASE doc_id % 3 WHEN 0 THEN 'cc-by-4.0' WHEN 1 THEN 'cc0' ELSE 'unknown' END")
def licence_policies(spark, sf):
    licence = F.when(F.col("doc_id") % 3 == 0, "CC-BY-4.0").when(F.col("doc_id") % 3 == 1, "cc0").otherwise("other")
    return ops.licence_policies(table(spark, sf, "documents").withColumn("licence", licence), "licence").select("doc_id", "embed", "credit")


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'ECONOMY' AND NOT p_size % 5 = 0 AND DATE '2024-01-01' + p_size <= DATE '2024-01-20' AND (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%')")
def vocabulary_due(spark, sf):
    p = table(spark, sf, "part")
    v = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), (F.col("p_size") % 5 == 0).alias("mastered"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("next_review"), F.col("p_name").alias("term"), F.col("p_brand").alias("meaning"), F.lit("").alias("context"))
    return ops.vocabulary_view(v, "2024-01-20", "ECONOMY", True, "RING").select("id")


@query(f"WITH {SESSIONS} SELECT event_id AS id FROM sessions ORDER BY kind = 'error', CASE WHEN kind <> 'error' THEN seconds END, CASE WHEN kind <> 'error' THEN user_id END, CASE WHEN kind <> 'error' THEN ts END, CASE WHEN kind = 'error' THEN ts END DESC, event_id LIMIT 200")
def annotation_order(spark, sf):
    a = sessions(spark, sf).select(F.col("event_id").alias("id"), (F.col("kind") == "error").alias("orphaned"), F.col("seconds").alias("position"), F.col("user_id").alias("start"), F.col("ts").alias("created"))
    return a.orderBy(*ops.annotation_order()).limit(200).select("id")


@query("WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM g) SELECT source, n FROM r WHERE k > 3 AND k <= 8")
def group_page_after(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("source")]
    third = g.orderBy(*order).limit(3).orderBy("n", F.desc("source")).first()["source"]
    return ops.after_group(g, order, "source", third, 5)


@query("WITH r AS (SELECT doc_id, contains(text, 'that') AS a, contains(text, 'from') AS b FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'source' END, CASE WHEN b THEN 'translation' END], lambda x: x IS NOT NULL), ',') AS sides, CASE WHEN a THEN 'source' ELSE 'translation' END AS lang FROM r WHERE a OR b")
def matched_sides(spark, sf):
    a, b = F.contains("text", F.lit("that")), F.contains("text", F.lit("from"))
    sides, lang = ops.matched_in(a, b)
    return table(spark, sf, "documents").where(a | b).select("doc_id", F.array_join(sides, ",").alias("sides"), lang.alias("lang"))


@query(f"WITH {BLOCKS} SELECT doc_id, position, CASE kind WHEN 'figure' THEN 'Fig. ' || position WHEN 'heading' THEN 'S' || section ELSE 'S' || section || ' ¶' || position END || CASE WHEN doc_id % 2 = 1 THEN ' · p. ' || section ELSE '' END AS label FROM blocks")
def display_labels(spark, sf):
    head = F.concat(F.lit("S"), F.col("section").cast("string"))
    quality = F.when(F.col("doc_id") % 2 == 1, "B").otherwise("A")
    return blocks(spark, sf).select("doc_id", "position", ops.display_label(F.col("kind"), F.col("position"), head, F.col("section"), quality).alias("label"))


@query("SELECT item_id, lower(split_part(text, ' ', 3)) AS term, strpos(lower(text), lower(split_part(text, ' ', 3))) > 0 AS found FROM benchmark WHERE NOT regexp_matches(split_part(text, ' ', 3), '[.!?\n]')")
def context_sentences(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("term", F.get(F.split("text", " "), F.lit(2))).where("NOT term RLIKE '[.!?\\n]'")
    c = b.withColumn("c", ops.context_sentence(F.col("text"), F.col("term")))
    inside = F.lower(F.call_function("substring", F.col("c.sentence"), F.col("c.start") + 1, F.length("term"))) == F.lower("term")
    return c.select("item_id", F.lower("term").alias("term"), inside.alias("found"))


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN status = 'done' THEN 'mastered' ELSE CASE WHEN item_id % 4 <= 0 THEN 'today' WHEN item_id % 4 = 1 THEN 'tomorrow' ELSE 'in ' || (item_id % 4) || ' days' END || ' (review ' || (item_id % 9 + 1) || ')' END AS shown FROM items")
def review_texts(spark, sf):
    i = F.col("item_id")
    return items(spark, sf).select("item_id", ops.review_text(F.col("status") == "done", i % 4, i % 9).alias("shown"))


@query(f"WITH {ITEMS} SELECT item_id, coalesce(CASE WHEN item_id % 7 = 0 THEN DATE '2020-02-02' END, CASE WHEN status = 'done' THEN DATE '2024-01-01' END) AS finished FROM items")
def finished_once(spark, sf):
    old = F.when(F.col("item_id") % 7 == 0, F.lit("2020-02-02").cast("date"))
    return items(spark, sf).select("item_id", ops.finished_at(old, F.col("status"), F.lit("2024-01-01").cast("date")).alias("finished"))


@query(f"WITH {SESSIONS} SELECT DISTINCT user_id, kind FROM sessions n WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM sessions o WHERE o.event_id % 2 = 1 AND o.seconds % 9 = 0 AND o.user_id = n.user_id AND o.kind = n.kind)")
def fresh_notifications(spark, sf):
    s = sessions(spark, sf)
    old = s.where("event_id % 2 = 1").withColumn("read", F.col("seconds") % 9 != 0)
    return ops.fresh_notifications(old, s.where("event_id % 2 = 0"), ["user_id", "kind"]).select("user_id", "kind")


@query(f"WITH {SESSIONS}, c AS (SELECT user_id, max(kind) AS cur FROM sessions WHERE user_id % 3 <> 0 GROUP BY user_id) SELECT event_id, seconds % 2 = 0 AND cur IS NOT NULL AND kind <> cur AS stale FROM sessions LEFT JOIN c USING (user_id)")
def stale_runs(spark, sf):
    s = sessions(spark, sf)
    current = s.where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("paper_id")).agg(F.max("kind").alias("commit"))
    runs = s.select("event_id", F.col("user_id").alias("paper_id"), F.col("kind").alias("commit"), F.when(F.col("seconds") % 2 == 0, "succeeded").otherwise("failed").alias("state"))
    return ops.stale_runs(runs, current).select("event_id", "stale")


@query("WITH u AS (SELECT p_name || p_size AS term, min(p_brand) AS translation FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), p AS (SELECT upper(p_name || p_size) AS term, max(p_type) AS translation FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT coalesce(u.term, p.term) AS term, coalesce(p.translation, u.translation) AS translation FROM u FULL JOIN p ON lower(u.term) = lower(p.term)")
def promoted_terms(spark, sf):
    p = table(spark, sf, "part").withColumn("term", F.concat("p_name", F.col("p_size").cast("string")))
    user = p.where("p_partkey % 2 = 0").groupBy("term").agg(F.min("p_brand").alias("translation"))
    paper = p.where("p_partkey % 3 = 0").groupBy(F.upper("term").alias("term")).agg(F.max("p_type").alias("translation"))
    return ops.promoted_terms(user, paper)


@query("WITH e AS (SELECT lower(trim(p_name)) AS k, min(p_partkey) AS entry_id FROM part GROUP BY 1), c AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, lower(trim(p_name || CASE WHEN l_linenumber > 4 THEN ' net' ELSE '' END)) AS k FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT candidate_id, entry_id, CASE WHEN entry_id IS NULL THEN 'created' ELSE 'linked' END AS action FROM c LEFT JOIN e USING (k)")
def accepted_candidates(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit(" "), F.upper("p_name")).alias("term"))
    n = F.col("l_linenumber")
    found = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("entry_id"))
    return ops.accepted_candidates(found.select((F.col("l_orderkey") * 10 + n).alias("candidate_id"), F.concat("term", F.when(n > 4, " net").otherwise("")).alias("term")), p)


@query(
    f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT doc_id, position, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'heading' THEN 0 WHEN 'figure' THEN 1 ELSE 2 END, position) AS k FROM blocks),
 g(doc_id, k, position, rest, taken) AS (SELECT doc_id, k, position, CASE WHEN n <= 1200 THEN 1200 - n ELSE 1200 END, n <= 1200 FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.position, CASE WHEN o.n <= g.rest THEN g.rest - o.n ELSE g.rest END, o.n <= g.rest FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1) SELECT doc_id, position FROM g WHERE taken"""
)
def slide_material(spark, sf):
    return ops.slide_material(blocks(spark, sf), {"heading": 0, "figure": 1, "paragraph": 2}, 1200)


@query(f"WITH {BLOCKS}, s AS (SELECT doc_id, section, '## ' || section || chr(10) || string_agg('[' || position || '] ' || text, chr(10) ORDER BY position) AS t FROM blocks GROUP BY doc_id, section) SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY section) AS context FROM s GROUP BY doc_id")
def rendered_context(spark, sf):
    return ops.rendered_context(blocks(spark, sf))


@query("WITH t AS (SELECT conv_id, turn, text, lag(text) OVER w AS before, lead(text) OVER w AS after, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN concat_ws(' — ', text, substr(before, 1, 60)) ELSE concat_ws(' — ', text, substr(after, 1, 60)) END AS snippet FROM t WHERE role <> 'system'")
def chat_snippets(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w)}).where("role <> 'system'")
    is_answer = F.col("role") == "assistant"
    question, answer = F.when(is_answer, F.col("before")).otherwise(F.col("text")), F.when(is_answer, F.col("text")).otherwise(F.col("after"))
    return c.select("conv_id", "turn", ops.chat_snippet(question, answer, is_answer).alias("snippet"))
