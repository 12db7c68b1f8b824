"""Queries over annotations, vocabulary, sections, sets, jobs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.operators import nested
from quirelab.operators import records as ops
from quirelab.plans.model import BLOCKS, SESSIONS, blocks, choose, sessions
from quirelab.plans.registry import query
from quirelab.session import table

_NOTES = """a AS (SELECT l_orderkey AS item_id, l_linenumber AS n, CASE l_partkey % 5 WHEN 0 THEN 'yellow' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' WHEN 3 THEN 'pink' ELSE 'purple' END AS colour,
 CASE WHEN l_quantity > 25 THEN 'see ' || l_linenumber WHEN l_quantity > 20 THEN ' ' END AS comment, CASE WHEN l_discount > 0.02 THEN l_partkey END AS block_id, CASE WHEN l_tax > 0.04 THEN 'note' ELSE 'highlight' END AS kind FROM lineitem)"""


def _annotations(spark, sf):
    q = F.col("l_quantity")
    colour = choose(F.col("l_partkey") % 5, dict(enumerate(ops.COLOURS)))
    comment = F.when(q > 25, F.concat(F.lit("see "), F.col("l_linenumber").cast("string"))).when(q > 20, " ")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("n"), colour.alias("colour"), comment.alias("comment"), F.when(F.col("l_discount") > 0.02, F.col("l_partkey")).alias("block_id"), F.when(F.col("l_tax") > 0.04, "note").otherwise("highlight").alias("kind"))


@query(
    f"WITH {_NOTES} SELECT item_id, count(*) AS total, count(*) FILTER (WHERE colour = 'yellow') AS yellow, count(*) FILTER (WHERE colour = 'green') AS green, count(*) FILTER (WHERE colour = 'blue') AS blue, count(*) FILTER (WHERE colour = 'pink') AS pink, count(*) FILTER (WHERE colour = 'purple') AS purple, count(*) FILTER (WHERE length(trim(comment)) > 0) AS with_comment, count(*) FILTER (WHERE block_id IS NULL) AS unplaced FROM a GROUP BY item_id"
)
def annotation_counts(spark, sf):
    return ops.annotation_counts(_annotations(spark, sf), "item_id")


@query(f"WITH {_NOTES} SELECT item_id, n, colour FROM a WHERE colour IN ('yellow', 'blue') AND length(trim(comment)) > 0 AND block_id IS NOT NULL AND kind = 'note'")
def filtered_annotations(spark, sf):
    return ops.filtered_annotations(_annotations(spark, sf), ["yellow", "blue"], True, True, "note").select("item_id", "n", "colour")


@query(
    "WITH v AS (SELECT p_brand AS owner, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'idiom' WHEN p_type LIKE '%COPPER' THEN 'term' ELSE 'word' END AS kind, p_size % 5 = 0 AS mastered, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS next_review FROM part) SELECT owner, count(*) AS total, count(*) FILTER (WHERE kind = 'word') AS word, count(*) FILTER (WHERE kind = 'idiom') AS idiom, count(*) FILTER (WHERE kind = 'term') AS term, count(*) FILTER (WHERE NOT mastered AND next_review <= DATE '2024-01-20') AS due FROM v GROUP BY owner"
)
def vocabulary_counts(spark, sf):
    kind = F.when(F.startswith(F.col("p_type"), F.lit("ECONOMY")), "idiom").when(F.endswith(F.col("p_type"), F.lit("COPPER")), "term").otherwise("word")
    v = table(spark, sf, "part").select(F.col("p_brand").alias("owner"), kind.alias("kind"), (F.col("p_size") % 5 == 0).alias("mastered"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("next_review"))
    return ops.vocabulary_counts(v, "owner", "2024-01-20")


@query(f"WITH {SESSIONS} SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS entry, kind AS stage, kind || ' ' || seconds AS message FROM sessions WHERE kind <> 'view'")
def log_timeline(spark, sf):
    detail = F.when(F.col("kind") == "view", F.lit('{"timeline": false}')).otherwise(F.lit('{"timeline": true, "n": 1}'))
    s = sessions(spark, sf).select(F.col("user_id").alias("job"), F.col("event_id").alias("n"), F.col("kind").alias("stage"), F.concat("kind", F.lit(" "), F.col("seconds").cast("string")).alias("message"), detail.alias("detail"))
    return ops.timeline(s)


@query(f"WITH {BLOCKS}, u AS (SELECT doc_id, position AS block_id, text || '!' AS text, CASE WHEN position % 5 = 0 THEN 'blocked' ELSE 'ready' END AS state FROM blocks WHERE position % 3 <> 1) SELECT b.doc_id, b.section, b.position AS block_id, coalesce(u.state, 'missing') AS state, CASE WHEN u.state <> 'blocked' THEN u.text END AS translation FROM blocks b LEFT JOIN u ON u.doc_id = b.doc_id AND u.block_id = b.position")
def section_units(spark, sf):
    b = blocks(spark, sf).withColumnRenamed("position", "block_id")
    units = b.where("block_id % 3 <> 1").select("doc_id", "block_id", F.concat("text", F.lit("!")).alias("text"), F.when(F.col("block_id") % 5 == 0, "blocked").otherwise("ready").alias("state"))
    return ops.section_units(b.select("doc_id", "section", "block_id"), units, "doc_id", "section")


_TREE = f"""{BLOCKS}, s AS (SELECT DISTINCT doc_id, section, CASE WHEN section % 3 = 0 THEN CAST(section AS VARCHAR) WHEN section % 3 = 1 THEN (section - 1) || '.' || section ELSE (section - 2) || '.' || (section - 1) || '.' || section END AS path FROM blocks),
 up AS (SELECT x.doc_id, x.section, y.section AS ancestor, CAST(len(string_split(y.path, '.')) AS BIGINT) AS depth FROM s x JOIN s y ON y.doc_id = x.doc_id AND (x.path = y.path OR starts_with(x.path, y.path || '.')))"""


def _sections(spark, sf):
    n, text = F.col("section"), lambda c: c.cast("string")
    path = F.when(n % 3 == 0, text(n)).when(n % 3 == 1, F.concat_ws(".", text(n - 1), text(n))).otherwise(F.concat_ws(".", text(n - 2), text(n - 1), text(n)))
    return blocks(spark, sf).select("doc_id", "section").distinct().withColumn("path", path)


@query(f"WITH {_TREE} SELECT doc_id, section, ancestor, depth FROM up")
def section_ancestors(spark, sf):
    return ops.ancestors(_sections(spark, sf), "doc_id", "section", "path")


@query(f"WITH {_TREE} SELECT b.doc_id * 1000000 + b.position AS anchor_id, up.ancestor AS section, up.depth FROM blocks b JOIN up USING (doc_id, section) WHERE b.position % 6 = 2")
def anchored_sections(spark, sf):
    b = blocks(spark, sf).withColumnRenamed("position", "block_id")
    anchors = b.where("block_id % 6 = 2").select((F.col("doc_id") * 1_000_000 + F.col("block_id")).alias("anchor_id"), "doc_id", "block_id")
    return ops.anchored_sections(anchors, b, ops.ancestors(_sections(spark, sf), "doc_id", "section", "path"), "doc_id")


@query(f"WITH {BLOCKS}, old AS (SELECT doc_id, position, md5(text) AS h FROM blocks), fresh AS (SELECT doc_id, position, md5(text || '!') AS h FROM blocks WHERE doc_id % 3 = 0 AND position % 2 = 0) SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT * FROM fresh")
def rebuilt_revisions(spark, sf):
    b, md5 = blocks(spark, sf), lambda c: F.md5(c.cast("binary")).alias("h")
    fresh = b.where("doc_id % 3 = 0 AND position % 2 = 0").select("doc_id", "position", md5(F.concat("text", F.lit("!"))))
    return ops.rebuilt(b.select("doc_id", "position", md5(F.col("text"))), fresh, "doc_id")


@query(
    "WITH own AS (SELECT ps.s_suppkey AS user_id, n.n_regionkey AS set_id, n.n_name AS entry, n.n_name || '!' AS value FROM supplier ps JOIN nation n ON n.n_nationkey = ps.s_nationkey), shared AS (SELECT n_regionkey AS set_id, n_name AS entry, n_name AS value FROM nation), wanted AS (SELECT s_suppkey AS user_id, CAST(s_suppkey % 5 AS BIGINT) AS set_id FROM supplier), missing AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = w.user_id AND o.set_id = w.set_id)) SELECT user_id, CAST(set_id AS BIGINT) AS set_id, entry, value, false AS copied FROM own UNION ALL SELECT m.user_id, CAST(m.set_id AS BIGINT), s.entry, s.value, true FROM missing m JOIN shared s ON s.set_id = m.set_id"
)
def own_copies(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey"), F.col("n_regionkey").cast("long").alias("set_id"), F.col("n_name").alias("entry"))
    s = table(spark, sf, "supplier")
    own = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("user_id"), "set_id", "entry", F.concat("entry", F.lit("!")).alias("value"))
    shared = n.select("set_id", "entry", F.col("entry").alias("value"))
    wanted = s.select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 5).cast("long").alias("set_id"))
    return ops.own_copies(own, shared, "user_id", "entry", wanted)


@query(
    "WITH j AS (SELECT o_orderkey AS job, o_orderpriority AS queue, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status, o_orderdate AS since FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY queue, status = 'queued' ORDER BY since, job) AS k FROM j) SELECT job, CASE WHEN status = 'queued' AND k <= 4 THEN 'running' ELSE status END AS status, status = 'queued' AND k <= 4 AS claimed FROM r"
)
def claimed_jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("queue"), status.alias("status"), F.col("o_orderdate").alias("since"))
    return ops.claimed(jobs, 4, "queue", "since").select("job", "status", "claimed")


@query(f"WITH {SESSIONS} SELECT event_id, CASE WHEN user_id IN (1, 2, 3) AND seconds % 2 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' WHEN seconds % 2 = 1 THEN CAST(ts AS TIMESTAMP) END AS read_at FROM sessions")
def marked_read(spark, sf):
    n = sessions(spark, sf).select("event_id", "user_id", F.when(F.col("seconds") % 2 == 1, F.col("ts").cast("timestamp")).alias("read_at"))
    return ops.marked_read(n, [1, 2, 3], "2024-05-01 00:00:00").select("event_id", "read_at")


@query(
    "WITH a AS (SELECT l_orderkey AS request, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS n, CASE WHEN l_linenumber <= 3 THEN 'first' ELSE 'second' END AS provider, l_returnflag = 'R' AS ok, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY request, provider ORDER BY n) AS k FROM a), t AS (SELECT *, coalesce(max(CAST(ok AS INTEGER)) OVER (PARTITION BY request ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM k WHERE k <= 2) SELECT request, row_number() OVER (PARTITION BY request ORDER BY n) AS attempt, provider, ok, tokens FROM t WHERE won = 0"
)
def attempt_usage(spark, sf):
    n = F.col("l_linenumber")
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), (n.cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("n"), F.when(n <= 3, "first").otherwise("second").alias("provider"), (F.col("l_returnflag") == "R").alias("ok"), F.col("l_quantity").cast("long").alias("tokens"))
    return ops.attempt_usage(a, "request", "n", 2)


@query("WITH d AS (SELECT c_custkey AS id, [lower(c_mktsegment), c_name] AS v FROM customer), e AS (SELECT id, unnest(v) AS value, unnest(range(len(v))) AS place FROM d) SELECT id, CAST(place AS INTEGER) AS place, value FROM e")
def asset_key_walk(spark, sf):
    inner = F.struct(F.lower("c_mktsegment").alias("asset_key"), F.lit(1).alias("n"))
    doc = F.to_json(F.struct(F.array(F.struct(inner.alias("image"))).alias("blocks"), F.struct(F.col("c_name").alias("asset_key"), F.lower("c_mktsegment").alias("alt")).alias("cover"), inner.alias("again")))
    return nested.key_strings(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), doc.alias("doc")), "id", "doc", ["asset_key"])


@query(
    r"""WITH h AS (SELECT 'source' AS kind, doc_id AS item, doc_id AS id, text FROM documents UNION ALL SELECT 'translation', doc_id - 1, doc_id, text FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'chat', conv_id, conv_id * 100 + turn, text FROM conversations WHERE role <> 'user' UNION ALL SELECT 'question', conv_id, conv_id * 100 + turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'note', item_id, item_id, text FROM benchmark UNION ALL SELECT 'annotation', doc_id, doc_id, source FROM documents),
 t AS (SELECT kind, item, id, regexp_extract_all(lower(text), '[\pL\pN]+') AS tokens FROM h), m AS (SELECT kind, item, id, CAST(len(list_filter(tokens, lambda x: x IN ('from', 'that'))) AS DOUBLE) AS score FROM t WHERE list_contains(tokens, 'from') AND list_contains(tokens, 'that')),
 g AS (SELECT item, max(score) AS best, count(*) AS hits, arg_max(kind, (score, kind)) AS top FROM m GROUP BY item), l AS (SELECT item, row_number() OVER (ORDER BY best DESC, item) - 1 AS rank FROM g),
 e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT e.item, list_cosine_similarity(e.v, q.v) AS sim FROM e, (SELECT v FROM e WHERE item = 0) q WHERE e.item <> 0 ORDER BY sim DESC, e.item LIMIT 50), sr AS (SELECT item, row_number() OVER (ORDER BY sim DESC, item) - 1 AS rank FROM s),
 f AS (SELECT item, sum(1.0 / (60 + rank + 1)) AS fused FROM (SELECT * FROM l UNION ALL SELECT * FROM sr) GROUP BY item)
 SELECT f.item, round(f.fused, 9) AS fused, coalesce(g.best, 0) AS score, coalesce(g.hits, 0) AS hits, g.top, CASE WHEN l.item IS NULL THEN 'semantic' WHEN sr.item IS NULL THEN 'lexical' ELSE 'both' END AS match_type FROM f LEFT JOIN g USING (item) LEFT JOIN l USING (item) LEFT JOIN sr USING (item) ORDER BY round(f.fused, 9) DESC, f.item LIMIT 20"""
)
def composed_search(spark, sf):
    """Search over all six streams, grouped by item and fused with the nearest vectors: the first page."""
    from quirelab.operators import search

    return search.searched(hit_streams(spark, sf), "from that", near_first(spark, sf)).limit(20)


def hit_streams(spark, sf):
    """The six streams of things that can be found: kind, item, id, text."""
    d, c, b = (table(spark, sf, n) for n in ("documents", "conversations", "benchmark"))
    hit = lambda rows, kind, item, i, text: rows.select(F.lit(kind).alias("kind"), item.alias("item"), i.alias("id"), F.col(text).alias("text"))
    doc, turn = F.col("doc_id"), F.col("conv_id") * 100 + F.col("turn")
    return [
        hit(d, "source", doc, doc, "text"),
        hit(d.where("doc_id % 2 = 1"), "translation", doc - 1, doc, "text"),
        hit(c.where("role <> 'user'"), "chat", F.col("conv_id"), turn, "text"),
        hit(c.where("role = 'user'"), "question", F.col("conv_id"), turn, "text"),
        hit(b, "note", F.col("item_id"), F.col("item_id"), "text"),
        hit(d, "annotation", doc, doc, "source"),
    ]


def near_first(spark, sf):
    """The fifty items that are nearest to item 0: item, rank from 0."""
    from quirelab.operators import search

    e = table(spark, sf, "embeddings")
    near = search.nearest(e.where("vec_id = 0"), e, "vec_id", "embedding", 50).select(F.col("vec_id").alias("item"), F.col("rank").alias("_r"))
    return near.select("item", (F.col("_r") - 1).alias("rank"))
