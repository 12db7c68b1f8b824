"""Queries over indexes that are built of the tables: ranked search by postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.operators import postings as ops
from quirelab.plans.model import BLOCKS, blocks
from quirelab.plans.records import hit_streams, near_first
from quirelab.plans.registry import query

_STREAMS = r"""h AS (SELECT 'source' AS kind, doc_id AS item, doc_id AS id, text FROM documents UNION ALL SELECT 'translation', doc_id - 1, doc_id, text FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'chat', conv_id, conv_id * 100 + turn, text FROM conversations WHERE role <> 'user' UNION ALL SELECT 'question', conv_id, conv_id * 100 + turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'note', item_id, item_id, text FROM benchmark UNION ALL SELECT 'annotation', doc_id, doc_id, source FROM documents),
 t AS (SELECT kind, item, id, regexp_extract_all(lower(text), '[\pL\pN]+') AS tokens FROM h)"""


def _index(spark, sf):
    rows = reduce(DataFrame.unionByName, hit_streams(spark, sf))
    return ops.build(rows.withColumn("at", F.timestamp_seconds("id")))


@query(
    rf"""WITH {_STREAMS}, m AS (SELECT kind, item, id, CAST(len(list_filter(tokens, lambda x: x IN ('from', 'that'))) AS DOUBLE) AS score FROM t WHERE list_contains(tokens, 'from') AND list_contains(tokens, 'that')),
 e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT e.item, list_cosine_similarity(e.v, q.v) AS sim FROM e, (SELECT v FROM e WHERE item = 0) q WHERE e.item <> 0 ORDER BY sim DESC, e.item LIMIT 50), sr AS (SELECT item, row_number() OVER (ORDER BY sim DESC, item) - 1 AS rank FROM s),
 a AS (SELECT * FROM m UNION ALL SELECT 'semantic', item, NULL, 0 FROM sr WHERE item NOT IN (SELECT item FROM m)),
 fc AS (SELECT *, CASE WHEN kind IN ('source', 'translation', 'semantic') THEN 'body' WHEN kind IN ('note', 'annotation') THEN 'notes' WHEN kind IN ('chat', 'question') THEN 'chat' END AS facet FROM a),
 b AS (SELECT item, max(score) AS score FROM m GROUP BY item), bt AS (SELECT b.item, b.score, max(m.id) AS latest FROM b JOIN m ON m.item = b.item AND m.score = b.score GROUP BY ALL),
 l AS (SELECT item, row_number() OVER (ORDER BY score DESC, latest DESC, item) - 1 AS rank FROM bt),
 f AS (SELECT item, round(sum(1.0 / (60 + rank + 1)), 9) AS fused, CASE WHEN item NOT IN (SELECT item FROM sr) THEN 'lexical' WHEN item NOT IN (SELECT item FROM l) THEN 'semantic' ELSE 'both' END AS match_type FROM (SELECT * FROM l UNION ALL SELECT * FROM sr) GROUP BY item),
 c AS (SELECT x.item, f.fused, f.match_type, count(*) AS n FROM fc x JOIN f USING (item) WHERE x.facet = 'body' GROUP BY ALL), g AS (SELECT *, row_number() OVER (ORDER BY fused DESC, item) AS k FROM c),
 p AS (SELECT * FROM g WHERE k > 3 AND k <= 13), best AS (SELECT x.*, row_number() OVER (PARTITION BY x.item ORDER BY x.score DESC, x.id DESC NULLS LAST, x.kind) AS k FROM fc x JOIN p USING (item) WHERE x.facet = 'body'),
 items AS (SELECT item, count(*) AS n FROM a GROUP BY item ORDER BY n DESC, item LIMIT 20)
 SELECT 'total' AS part, 'hits' AS name, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS DOUBLE) AS value, count(*) AS n FROM a
 UNION ALL SELECT 'total', 'items', NULL, NULL, NULL, NULL, count(DISTINCT item) FROM a
 UNION ALL SELECT 'facet', v.name, NULL, NULL, NULL, NULL, (SELECT count(*) FROM fc WHERE facet = v.name) FROM (VALUES ('body'), ('notes'), ('chat'), ('article')) v(name)
 UNION ALL SELECT 'item', NULL, item, NULL, NULL, NULL, n FROM items
 UNION ALL SELECT 'group', match_type, item, NULL, k - 3, fused, n FROM p
 UNION ALL SELECT 'hit', kind, item, id, k, score, NULL FROM best WHERE k <= 5"""
)
def indexed_search(spark, sf):
    """The second page of a search of all six streams, whose first one had three groups: totals, facets of all hits, then of
    the facet body the groups in fused order with their five best hits."""
    index, near = _index(spark, sf), near_first(spark, sf)
    first = ops.search_page(index, "from that", near, facet="body", limit=3).groups.orderBy("place").collect()
    page = ops.search_page(index, "from that", near, facet="body", after=first[-1]["item"] if first else None, limit=10)
    total = lambda name: page.totals.select(F.lit("total").alias("part"), F.lit(name).alias("name"), F.col(name).alias("n"))
    parts = [
        total("hits"),
        total("items"),
        page.facets.select(F.lit("facet").alias("part"), F.col("facet").alias("name"), "n"),
        page.items.select(F.lit("item").alias("part"), "item", "n"),
        page.groups.select(F.lit("group").alias("part"), F.col("match_type").alias("name"), "item", F.col("place").cast("long").alias("place"), "value", "n"),
        page.best.select(F.lit("hit").alias("part"), F.col("kind").alias("name"), "item", "id", F.col("place").cast("long").alias("place"), F.col("score").alias("value")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("part", "name", "item", "id", "place", "value", "n")


@query(
    rf"""WITH {_STREAMS}, m AS (SELECT kind, item, id, CAST(len(list_filter(tokens, lambda x: x IN ('from', 'that'))) AS BIGINT) AS score FROM t WHERE list_contains(tokens, 'from') AND list_contains(tokens, 'that')) SELECT kind, item, id, score FROM m"""
)
def indexed_hits(spark, sf):
    return ops.hits(_index(spark, sf), "from that").select("kind", "item", "id", "score")


@query(
    rf"""WITH {BLOCKS}, t AS (SELECT doc_id, position, regexp_extract_all(lower(text), '[\pL\pN]+') AS tokens FROM blocks), m AS (SELECT doc_id, position, CAST(len(list_filter(tokens, lambda x: x IN ('the', 'that'))) AS BIGINT) AS score FROM t WHERE list_contains(tokens, 'the') AND list_contains(tokens, 'that')) SELECT doc_id, position, score FROM m ORDER BY score DESC, doc_id, position LIMIT 10"""
)
def indexed_top(spark, sf):
    """The ten best blocks of all documents; blocks of postings that cannot reach them are skipped."""
    rows = blocks(spark, sf).select(F.lit("block").alias("kind"), F.col("doc_id").alias("item"), F.struct("doc_id", "position").alias("id"), F.lit(None).cast("timestamp").alias("at"), "text")
    best, _ = ops.top(ops.build(rows), "the that", 10)
    return best.select("id.doc_id", "id.position", "score")
