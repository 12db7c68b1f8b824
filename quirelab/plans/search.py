"""Queries over text: matching, ranking, fusion, vectors, chat."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelab.operators import fragments, neighbours
from quirelab.operators import search as ops
from quirelab.operators.library import best_per_key
from quirelab.plans.model import BLOCKS, blocks
from quirelab.plans.registry import query
from quirelab.session import table

TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) > 0)"


@query(
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, position, {TOKENS} AS tokens FROM blocks), m AS (SELECT doc_id, position, CAST(len(list_filter(tokens, lambda x: x IN ('that', 'with'))) AS BIGINT) AS score FROM t WHERE list_contains(tokens, 'that') AND list_contains(tokens, 'with'))
 SELECT doc_id, max(score) AS score, count(*) AS hits FROM m GROUP BY doc_id ORDER BY score DESC, hits DESC, doc_id LIMIT 10"""
)
def search_documents(spark, sf):
    hits = ops.match(blocks(spark, sf), "text", "that  with ")
    grouped = hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("hits"))
    return grouped.orderBy(F.desc("score"), F.desc("hits"), "doc_id").limit(10)


@query(
    f"""WITH h AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'chat', conv_id * 100 + turn, text FROM conversations UNION ALL SELECT 'quote', item_id, text FROM benchmark),
 t AS (SELECT kind, id, {TOKENS} AS tokens FROM h) SELECT kind, id, CAST(len(list_filter(tokens, lambda x: x = 'theation')) AS BIGINT) AS score FROM t WHERE list_contains(tokens, 'theation')"""
)
def hit_union(spark, sf):
    return ops.match(_streams(spark, sf), "text", "theation").select("kind", "id", "score")


def _streams(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.lit("chat").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("quote").alias("kind"), F.col("item_id").alias("id"), "text")
    return d.unionByName(c).unionByName(b)


@query(
    f"""WITH h AS (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'chat', text FROM conversations UNION ALL SELECT 'quote', text FROM benchmark)
 SELECT count(*) AS hits, count(*) FILTER (WHERE kind IN ('chat', 'quote')) AS notes, count(*) FILTER (WHERE kind = 'document') AS body FROM (SELECT kind, {TOKENS} AS tokens FROM h) WHERE list_contains(tokens, 'that')"""
)
def search_facets(spark, sf):
    hits = ops.match(_streams(spark, sf), "text", "that")
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("kind").isin("chat", "quote")).alias("notes"), F.count_if(F.col("kind") == "document").alias("body"))


@query(
    f"""WITH h AS (SELECT source AS grp, doc_id AS id, {TOKENS} AS tokens FROM documents), m AS (SELECT grp, id, CAST(len(list_filter(tokens, lambda x: x = 'from')) AS BIGINT) AS score FROM h WHERE list_contains(tokens, 'from')),
 g AS (SELECT grp, max(score) AS best, max(id) AS latest, count(*) AS n FROM m GROUP BY grp), r AS (SELECT m.*, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id DESC) AS k FROM m)
 SELECT r.grp, r.id, r.score, g.best, g.latest, g.n FROM r JOIN g USING (grp) WHERE k <= 5"""
)
def group_and_sort(spark, sf):
    hits = ops.match(table(spark, sf, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), "text"), "text", "from")
    # Sums combine before they meet, and each task keeps its own five best of a group.
    groups = hits.groupBy("grp").agg(F.max("score").alias("best"), F.max("id").alias("latest"), F.count(F.lit(1)).alias("n"))
    best = best_per_key(hits, ["grp"], [F.desc("score"), F.desc("id")], 5)
    return best.join(groups, "grp").select("grp", "id", "score", "best", "latest", "n")


@query(
    f"""WITH a AS (SELECT doc_id, CAST(len(list_filter({TOKENS}, lambda x: x = 'that')) AS BIGINT) AS s FROM documents), b AS (SELECT doc_id, CAST(len(list_filter({TOKENS}, lambda x: x = 'this')) AS BIGINT) AS s FROM documents)
 SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.s, 0) + coalesce(y.s, 0) AS score, x.s IS NOT NULL AS in_source, y.s IS NOT NULL AS in_translation, CASE WHEN x.s IS NOT NULL THEN 'source' ELSE 'translation' END AS lang
 FROM (SELECT * FROM a WHERE s > 0) x FULL JOIN (SELECT * FROM b WHERE s > 0) y ON x.doc_id = y.doc_id"""
)
def full_outer_hit_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    x, y = (ops.match(d, "text", q).select("doc_id", F.col("score").alias(s)) for q, s in (("that", "a"), ("this", "b")))
    zero = F.lit(0).cast("long")
    return x.join(y, "doc_id", "full").select("doc_id", (F.coalesce("a", zero) + F.coalesce("b", zero)).alias("score"), F.col("a").isNotNull().alias("in_source"), F.col("b").isNotNull().alias("in_translation"), F.when(F.col("a").isNotNull(), "source").otherwise("translation").alias("lang"))


@query("SELECT conv_id, turn, coalesce(CASE WHEN role = 'assistant' THEN last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, turn) AS pair_turn FROM conversations WHERE role <> 'system'")
def asof_user_message(spark, sf):
    return ops.paired_messages(table(spark, sf, "conversations").where("role <> 'system'")).select("conv_id", "turn", "pair_turn")


@query(
    f"""WITH p AS (SELECT conv_id, turn, text, coalesce(CASE WHEN role = 'assistant' THEN last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, turn) AS pair_turn FROM conversations WHERE role <> 'system'),
 t AS (SELECT conv_id, turn, pair_turn, {TOKENS} AS tokens FROM p) SELECT conv_id, pair_turn, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(len(list_filter(tokens, lambda x: x = 'that'))) AS BIGINT) AS score FROM t WHERE list_contains(tokens, 'that') GROUP BY conv_id, pair_turn"""
)
def chat_pair_hits(spark, sf):
    pairs = ops.paired_messages(table(spark, sf, "conversations").where("role <> 'system'"))
    return ops.match(pairs, "text", "that").groupBy("conv_id", "pair_turn").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum("score").alias("score"))


@query("WITH w AS (SELECT *, lead(role) OVER v AS next_role, lead(turn) OVER v AS next_turn FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn AS question, next_turn AS answer FROM w WHERE role = 'user' AND next_role = 'assistant'")
def qa_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_turn": F.lead("turn").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", F.col("turn").alias("question"), F.col("next_turn").alias("answer"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z])that($|[^A-Za-z])') AS affected FROM documents WHERE contains(lower(text), 'that')")
def word_boundary_terms(spark, sf):
    d = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("that")))
    return d.select("doc_id", F.col("text").rlike("(?i)(?<![A-Za-z])that(?![A-Za-z])").alias("affected"))


@query(
    """WITH d AS (SELECT doc_id, text, strpos(lower(text), 'theation') AS place FROM documents WHERE contains(lower(text), 'theation')), s AS (SELECT doc_id, place, substr(text, greatest(1, place - 60), 160) AS raw, greatest(1, place - 60) > 1 AS cut_left, length(text) >= greatest(1, place - 60) + 160 AS cut_right FROM d),
 e AS (SELECT *, replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM s) SELECT doc_id, (CASE WHEN cut_left THEN '…' ELSE '' END) || regexp_replace(safe, '(theation)', '<mark>\\1</mark>', 'gi') || (CASE WHEN cut_right THEN '…' ELSE '' END) AS snippet FROM e"""
)
def snippets(spark, sf):
    hits = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("theation")))
    return hits.select("doc_id", ops.snippet(F.col("text"), "theation").alias("snippet"))


@query()
def best_snippets(spark, sf):
    """The fragment of each hit that holds the most words of the search; tests hold it against every window."""
    hits = ops.match(table(spark, sf, "documents").select("doc_id", "text"), "text", "that from")
    return hits.select("doc_id", fragments.best_fragment(F.col("text"), ("that", "from")).alias("snippet"))


@query(
    """WITH c AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}'), lambda x: x NOT IN ('the', 'and', 'for', 'that', 'with'))) AS t FROM benchmark),
 d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}'), lambda x: x NOT IN ('the', 'and', 'for', 'that', 'with'))) AS t FROM documents),
 ct AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM c), dt AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d), s AS (SELECT ct.item_id, dt.doc_id, round(count(*) / sqrt(ct.n * dt.n), 6) AS score FROM ct JOIN dt USING (w) GROUP BY ct.item_id, dt.doc_id, ct.n, dt.n),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s) SELECT item_id, doc_id, score FROM r WHERE k <= 6"""
)
def lexical_overlap(spark, sf):
    return ops.lexical_candidates(table(spark, sf, "benchmark"), "item_id", table(spark, sf, "documents"), "doc_id", "text", 6)


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(qe, e) AS sim FROM q, v WHERE query_id <> vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, round(sim, 6) AS similarity, k AS rank FROM r WHERE k <= 10"""
)
def cosine_topk(spark, sf):
    """Exact neighbours of a stated query set: vectors whose id is a multiple of 20."""
    e = table(spark, sf, "embeddings")
    return ops.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


@query()
def ann_topk(spark, sf):
    """Neighbours of the same query set by an index over all vectors. Tests hold it against the exact neighbours."""
    e = table(spark, sf, "embeddings")
    return neighbours.search(neighbours.build(e, "vec_id", "embedding"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT b.vec_id, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b WHERE a.vec_id = 7 AND b.vec_id <> 7), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS k FROM s) SELECT vec_id, round(sim, 4) AS similarity FROM r WHERE k <= 10"""
)
def similar_items(spark, sf):
    e = table(spark, sf, "embeddings")
    return ops.nearest(e.where("vec_id = 7"), e, "vec_id", "embedding", 10).select("vec_id", F.bround("similarity", 4).alias("similarity"))


def _ranked_sql(name: str, word: str) -> str:
    return f"{name} AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS r FROM (SELECT doc_id, len(list_filter({TOKENS}, lambda x: x = '{word}')) AS s FROM documents) WHERE s > 0)"


_RANKED = f"{_ranked_sql('a', 'that')}, {_ranked_sql('b', 'from')}"


def _lists(spark, sf):
    """The rankings of all hits of two searches."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return [ops.ranked(ops.match(d, "text", word), "doc_id", [F.desc("score"), F.col("doc_id")]) for word in ("that", "from")]


@query(f"WITH {_RANKED}, u AS (SELECT id, r FROM a UNION ALL SELECT id, r FROM b) SELECT id, round(sum(1.0 / (60 + r + 1)), 9) AS score FROM u GROUP BY id")
def rrf_fuse(spark, sf):
    return ops.fuse(_lists(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_RANKED} SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'semantic' WHEN y.id IS NULL THEN 'lexical' ELSE 'both' END AS match_type FROM (SELECT id FROM a) x FULL JOIN (SELECT id FROM b) y ON x.id = y.id")
def match_type(spark, sf):
    lexical, semantic = _lists(spark, sf)
    return ops.match_types(lexical, semantic)


@query(f"WITH {BLOCKS} SELECT doc_id, position, CAST((CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'from') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'theation') THEN 1 ELSE 0 END) AS INTEGER) AS relevance FROM blocks WHERE kind = 'heading'")
def section_relevance(spark, sf):
    terms = F.array(F.lit("that"), F.lit("from"), F.lit("theation"))
    return blocks(spark, sf).where("kind = 'heading'").select("doc_id", "position", F.size(F.filter(terms, lambda t: F.contains(F.lower("text"), t))).alias("relevance"))


@query(f"WITH {BLOCKS}, m AS (SELECT doc_id, position, text, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k FROM blocks WHERE list_contains({TOKENS}, 'that')) SELECT doc_id, position FROM m WHERE k <= 3")
def in_paper_search(spark, sf):
    return best_per_key(ops.match(blocks(spark, sf), "text", "that"), ["doc_id"], [F.col("position")], 3).select("doc_id", "position")
