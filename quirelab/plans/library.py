"""Queries over library items: filters, facets, joins, sorting, paging, writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelab.operators import library as ops
from quirelab.plans.model import ENTRIES, ITEMS, PAPERS, PRIORITY_RANK, QUICK, STATUSES, choose, entries, items, papers
from quirelab.plans.registry import query
from quirelab.session import table



@query(f"WITH {ITEMS} SELECT item_id, status, priority, price FROM items WHERE status IN ('planned', 'up_next') AND priority IN ('high', 'mid') AND added_on >= DATE '1997-01-01'")
def list_filtered(spark, sf):
    rows = items(spark, sf)
    wanted = ops.all_of([ops.one_of("status", QUICK["unread"]), ops.one_of("priority", ["high", "mid"]), None, F.col("added_on") >= "1997-01-01"])
    return rows.where(wanted).select("item_id", "status", "priority", "price")


@query(f"WITH {ITEMS} SELECT item_id, user_id, added_on FROM items WHERE user_id = 42")
def scan_of_user(spark, sf):
    return items(spark, sf).where("user_id = 42").select("item_id", "user_id", "added_on")


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN status IN ('planned','up_next') THEN 'unread' WHEN status IN ('reading','on_hold') THEN 'in_progress' WHEN status = 'done' THEN 'done' ELSE 'recheck' END AS quick FROM items")
def quick_filter_groups(spark, sf):
    return items(spark, sf).select("item_id", choose(F.col("status"), {s: q for q, ss in QUICK.items() for s in ss}).alias("quick"))


@query(f"WITH {PAPERS} SELECT paper_id, title FROM papers WHERE list_has_any(tags, ['red', 'ring'])")
def tags_overlap(spark, sf):
    return papers(spark, sf).where(F.arrays_overlap("tags", F.array(F.lit("red"), F.lit("ring")))).select("paper_id", "title")


@query(f"WITH {ITEMS}, {ENTRIES} SELECT item_id, status FROM items WHERE EXISTS (SELECT 1 FROM entries e WHERE e.item_id = items.item_id AND e.collection_id IN (3, 5, 8))")
def in_collections(spark, sf):
    return ops.in_collection(items(spark, sf), entries(spark, sf), [3, 5, 8]).select("item_id", "status")


@query(f"WITH {ITEMS} SELECT item_id, CAST(year(added_on) AS INTEGER) AS year FROM items WHERE year(added_on) IN (1996, 1999)")
def year_in(spark, sf):
    return items(spark, sf).where(F.year("added_on").isin(1996, 1999)).select("item_id", F.year("added_on").alias("year"))


@query(f"WITH {PAPERS} SELECT paper_id, title, brand FROM papers WHERE title ILIKE '%WID%' OR len(list_filter([brand, kind], lambda x: x ILIKE '%#12%')) > 0")
def author_contains_or_title(spark, sf):
    names = F.array("brand", "kind")
    return papers(spark, sf).where(ops.contains_any_case(F.col("title"), "WID") | F.exists(names, lambda x: ops.contains_any_case(x, "#12"))).select("paper_id", "title", "brand")


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ABCDEF00-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') ELSE text END AS raw FROM documents) SELECT doc_id, CASE WHEN regexp_full_match(lower(trim(raw)), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN lower(trim(raw)) END AS revision_id FROM x")
def safe_uuid(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ABCDEF00-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", ops.uuid_or_null(raw).alias("revision_id"))


@query(
    f"""WITH {ITEMS}, latest AS (SELECT o_orderkey AS item_id, max(l_linenumber) AS latest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
 wanted AS (SELECT item_id, CAST(item_id % 7 AS INTEGER) AS w FROM items), own AS (SELECT DISTINCT l_orderkey AS item_id, l_linenumber AS w FROM lineitem)
 SELECT l.item_id, coalesce(o.w, l.latest) AS revision FROM latest l JOIN wanted USING (item_id) LEFT JOIN own o ON o.item_id = l.item_id AND o.w = wanted.w"""
)
def effective_revision(spark, sf):
    """The revision of the reading position if the item has it, else the latest."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("w"))
    wanted = items(spark, sf).select("item_id", (F.col("item_id") % 7).cast("int").alias("w"))
    latest = li.groupBy("item_id").agg(F.max("w").alias("latest"))
    return wanted.join(li.distinct().withColumn("own", F.col("w")), ["item_id", "w"], "left").join(latest, "item_id", "left").select("item_id", F.coalesce("own", "latest").alias("revision"))


@query(f"WITH {ITEMS} SELECT item_id, status, priority FROM items WHERE status IN ('done') AND priority IN ('high')")
def saved_filter(spark, sf):
    chosen = ops.merged_filter({"status": ["reading"], "priority": ["high"]}, {"status": ["done"], "priority": None})
    return items(spark, sf).where(ops.all_of([ops.one_of(k, v) for k, v in chosen.items()])).select("item_id", "status", "priority")


@query(f"WITH {ITEMS} SELECT value, CAST(count(item_id) AS BIGINT) AS n FROM (VALUES ('planned'), ('up_next'), ('reading'), ('done'), ('reread'), ('on_hold')) v(value) LEFT JOIN items ON status = value AND priority = 'low' AND status <> 'reread' GROUP BY value")
def facet_status_zero_fill(spark, sf):
    return ops.facet(items(spark, sf).where("priority = 'low' AND status <> 'reread'"), "status", STATUSES)


@query(f"WITH {PAPERS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM papers) GROUP BY tag ORDER BY n DESC, tag LIMIT 100")
def facet_tags(spark, sf):
    return ops.top_tags(papers(spark, sf), "tags", 100)


@query(f"WITH {PAPERS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM papers) WHERE starts_with(lower(tag), 'b') GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def tag_prefix_counts(spark, sf):
    return ops.top_tags(papers(spark, sf), "tags", 20, "B")


@query(f"WITH {ITEMS}, {ENTRIES} SELECT collection_id, count(*) AS n FROM entries WHERE item_id IN (SELECT item_id FROM items WHERE status = 'reading') GROUP BY collection_id")
def facet_collections(spark, sf):
    return entries(spark, sf).join(items(spark, sf).where("status = 'reading'"), "item_id", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAPERS} SELECT year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY year")
def facet_years(spark, sf):
    return papers(spark, sf).where("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS}, {ENTRIES} SELECT collection_id, count(*) AS entries, count(*) FILTER (WHERE status = 'done') AS done FROM entries LEFT JOIN items USING (item_id) GROUP BY collection_id")
def filtered_count_by_collection(spark, sf):
    return entries(spark, sf).join(items(spark, sf), "item_id", "left").groupBy("collection_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status") == "done").alias("done"))


@query(f"WITH {ITEMS} SELECT count(*) AS n, count(*) FILTER (WHERE status <> 'done' AND deadline IS NULL) AS unstarted FROM items WHERE priority = 'high'")
def counts_of_filtered(spark, sf):
    return items(spark, sf).where("priority = 'high'").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") != "done") & F.col("deadline").isNull()).alias("unstarted"))


@query(f"WITH {ITEMS} SELECT item_id, deadline FROM items ORDER BY deadline DESC NULLS LAST, item_id DESC LIMIT 50")
def sort_nulls_last(spark, sf):
    return items(spark, sf).select("item_id", "deadline").orderBy(*ops.sort_columns("deadline", True, "item_id")).limit(50)


@query(f"WITH {ITEMS}, r AS (SELECT item_id, CASE priority WHEN 'high' THEN 0 WHEN 'mid' THEN 1 WHEN 'low' THEN 2 END AS rank FROM items) SELECT item_id, rank FROM r ORDER BY rank ASC NULLS LAST, item_id LIMIT 40")
def sort_by_priority(spark, sf):
    ranked = items(spark, sf).select("item_id", choose(F.col("priority"), PRIORITY_RANK).alias("rank"))
    return ranked.orderBy(*ops.sort_columns("rank", False, "item_id")).limit(40)


@query(f"WITH {ITEMS} SELECT item_id, added_on FROM items WHERE added_on < DATE '1998-06-01' OR (added_on = DATE '1998-06-01' AND item_id < 5000) ORDER BY added_on DESC, item_id DESC LIMIT 21")
def keyset_page(spark, sf):
    cursor = ops.decode_cursor(ops.encode_cursor(dt.date(1998, 6, 1), 5000))
    return ops.page(items(spark, sf).select("item_id", "added_on"), "added_on", "item_id", 20, (dt.date.fromisoformat(cursor[0]), cursor[1]))


@query(f"WITH {ITEMS} SELECT item_id, deadline FROM items WHERE deadline IS NULL AND item_id > 300 ORDER BY item_id LIMIT 21")
def keyset_page_of_nulls(spark, sf):
    return ops.page(items(spark, sf).select("item_id", "deadline"), "deadline", "item_id", 20, (None, 300), descending=False)


@query(f"WITH {ITEMS}, {ENTRIES}, r AS (SELECT item_id, collection_id, is_self, position, date_diff('day', DATE '1998-01-01', deadline) AS days_left, row_number() OVER (PARTITION BY item_id ORDER BY collection_id) AS k FROM entries JOIN items USING (item_id) WHERE deadline >= DATE '1998-01-01') SELECT item_id, collection_id, CAST(days_left AS INTEGER) AS days_left FROM r WHERE k = 1 ORDER BY days_left, is_self DESC, position, item_id LIMIT 30")
def nearest_deadline(spark, sf):
    due = entries(spark, sf).join(items(spark, sf), "item_id").where("deadline >= DATE '1998-01-01'").withColumn("days_left", F.datediff("deadline", F.lit("1998-01-01").cast("date")))
    first = ops.best_per_key(due, ["item_id"], [F.col("days_left"), F.col("collection_id")])
    return first.orderBy("days_left", F.desc("is_self"), "position", "item_id").limit(30).select("item_id", "collection_id", "days_left")


@query(f"WITH {ITEMS}, r AS (SELECT user_id, item_id, added_on, row_number() OVER (PARTITION BY user_id ORDER BY added_on DESC, item_id DESC) AS k FROM items) SELECT user_id, item_id, added_on FROM r WHERE k = 1")
def latest_per_key(spark, sf):
    return ops.best_per_key(items(spark, sf).select("user_id", "item_id", "added_on"), ["user_id"], [F.desc("added_on"), F.desc("item_id")])


@query(f"WITH {ITEMS}, r AS (SELECT user_id, item_id, price, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, added_on DESC, item_id) AS k FROM items) SELECT user_id, item_id, price FROM r WHERE k <= 5")
def top5_per_group(spark, sf):
    rows = ops.best_per_key(items(spark, sf), ["user_id"], [F.desc("price"), F.desc("added_on"), F.col("item_id")], 5)
    return rows.select("user_id", "item_id", "price")


@query(f"WITH {ITEMS}, {ENTRIES}, m AS (SELECT collection_id, max(position) AS last FROM entries WHERE item_id % 2 = 0 GROUP BY collection_id), fresh AS (SELECT collection_id, item_id FROM entries WHERE item_id % 2 = 1) SELECT f.collection_id, f.item_id, CAST(coalesce(m.last, -1) + row_number() OVER (PARTITION BY f.collection_id ORDER BY f.item_id) AS BIGINT) AS position FROM fresh f LEFT JOIN m USING (collection_id)")
def append_positions(spark, sf):
    all_rows = entries(spark, sf)
    last = all_rows.where("item_id % 2 = 0").groupBy("collection_id").agg(F.max("position").alias("last"))
    w = Window.partitionBy("collection_id").orderBy("item_id")
    return all_rows.where("item_id % 2 = 1").join(last, "collection_id", "left").select("collection_id", "item_id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).cast("long").alias("position"))


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE item_id % 4 = 0 AND item_id NOT IN (SELECT item_id FROM items WHERE status = 'done')")
def set_difference(spark, sf):
    rows = items(spark, sf)
    return rows.where("item_id % 4 = 0").join(rows.where("status = 'done'"), "item_id", "left_anti").select("item_id")


@query("SELECT DISTINCT lower(trim(p_name)) || p_size AS term FROM part WHERE lower(trim(p_name)) || p_size NOT IN (SELECT lower(trim(p_name)) || p_size FROM part WHERE p_partkey % 40 < 30 UNION SELECT lower(p_type) FROM part)")
def anti_known(spark, sf):
    p = table(spark, sf, "part")
    term = F.concat(F.lower(F.trim("p_name")), F.col("p_size").cast("string")).alias("term")
    known = p.where("p_partkey % 40 < 30").select(term).union(p.select(F.lower("p_type")))
    return p.select(term).distinct().join(known, "term", "left_anti")


@query("WITH old AS (SELECT p_partkey AS id, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS id, p_type AS v FROM part WHERE p_partkey % 2 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS action FROM old o FULL JOIN new n ON o.id = n.id")
def upsert_merge(spark, sf):
    p = table(spark, sf, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("old"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").otherwise("update")
    return old.join(new, "id", "full").select("id", F.coalesce("new", "old").alias("v"), action.alias("action"))


@query("WITH hashed AS (SELECT doc_id, lang, md5(text) AS h FROM documents), stored AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN md5('x') ELSE h END AS h FROM hashed WHERE doc_id % 3 <> 0) SELECT doc_id, lang, h FROM hashed a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc_id = a.doc_id AND s.lang = a.lang AND s.h = a.h)")
def changed_sources(spark, sf):
    """Rows whose (id, model, hash) is not stored yet."""
    hashed = table(spark, sf, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))
    stored = hashed.where("doc_id % 3 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, F.md5(F.lit("x").cast("binary"))).otherwise(F.col("h")))
    return hashed.join(stored, ["doc_id", "lang", "h"], "left_anti")


@query(f"WITH {PAPERS}, u AS (SELECT paper_id, list_distinct(list_concat(tags, ['new', 'red'])) AS t FROM papers) SELECT paper_id, CAST(len(t) AS INTEGER) AS n, list_contains(t, 'new') AS has_new, array_to_string(list_sort(t), ',') AS tags FROM u")
def bulk_tags(spark, sf):
    t = F.array_distinct(F.concat("tags", F.array(F.lit("new"), F.lit("red"))))
    return papers(spark, sf).select("paper_id", F.size(t).alias("n"), F.array_contains(t, "new").alias("has_new"), F.array_join(F.array_sort(t), ",").alias("tags"))


@query(f"WITH {PAPERS} SELECT paper_id, array_to_string(list_filter(tags, lambda x: x NOT IN ('red', 'small')), ' ') AS left_over FROM papers")
def accepted_tags_removed(spark, sf):
    return papers(spark, sf).select("paper_id", F.array_join(F.filter("tags", lambda x: ~x.isin("red", "small")), " ").alias("left_over"))


@query(f"WITH {ITEMS}, a AS (SELECT item_id FROM items WHERE user_id = 7 AND item_id % 3 <> 0), b AS (SELECT item_id FROM items WHERE user_id = 7 AND item_id % 2 = 0) SELECT (SELECT count(*) FROM a WHERE item_id NOT IN (SELECT item_id FROM b)) AS only_given, (SELECT count(*) FROM b WHERE item_id NOT IN (SELECT item_id FROM a)) AS missing")
def reorder_set_equality(spark, sf):
    own = items(spark, sf).where("user_id = 7")
    both = own.where("item_id % 3 <> 0").select("item_id", F.lit(1).alias("a")).join(own.where("item_id % 2 = 0").select("item_id", F.lit(1).alias("b")), "item_id", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_given"), F.count_if(F.col("a").isNull()).alias("missing"))


@query(f"WITH {ITEMS}, {PAPERS}, s AS (SELECT title, min(paper_id) AS survivor FROM papers GROUP BY title), m AS (SELECT p.paper_id, s.survivor FROM papers p JOIN s USING (title)), moved AS (SELECT i.user_id, coalesce(m.survivor, i.paper_id) AS paper_id, i.item_id FROM items i LEFT JOIN m USING (paper_id)) SELECT user_id, paper_id, min(item_id) AS item_id, count(*) AS merged FROM moved GROUP BY user_id, paper_id")
def duplicate_merge(spark, sf):
    """Papers of one title become the first; items that then meet for a user become one."""
    p = papers(spark, sf)
    to = p.join(p.groupBy("title").agg(F.min("paper_id").alias("survivor")), "title").select("paper_id", "survivor")
    moved = items(spark, sf).join(to, "paper_id", "left").withColumn("paper", F.coalesce("survivor", "paper_id"))
    return moved.groupBy("user_id", F.col("paper").alias("paper_id")).agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("merged"))


@query(f"WITH {ITEMS}, {ENTRIES}, mine AS (SELECT DISTINCT paper_id FROM items WHERE user_id = 11) SELECT paper_id, title FROM (SELECT p_partkey AS paper_id, p_name AS title, p_brand FROM part) WHERE p_brand = 'Brand#1' OR paper_id IN (SELECT paper_id FROM mine)")
def access_predicate(spark, sf):
    mine = items(spark, sf).where("user_id = 11").select("paper_id").distinct().withColumn("mine", F.lit(True))
    return papers(spark, sf).join(mine, "paper_id", "left").where((F.col("brand") == "Brand#1") | F.col("mine")).select("paper_id", "title")


@query(f"WITH {ITEMS} SELECT item_id, CAST(year(added_on) AS INTEGER) AS revision, added_on = max(added_on) OVER (PARTITION BY user_id) AS is_current FROM items")
def revisions_with_current(spark, sf):
    w = Window.partitionBy("user_id")
    return items(spark, sf).select("item_id", F.year("added_on").alias("revision"), (F.col("added_on") == F.max("added_on").over(w)).alias("is_current"))


@query(f"WITH {ITEMS}, {ENTRIES} SELECT e.collection_id, e.item_id, i.status FROM entries e JOIN items i ON i.item_id = e.item_id AND i.user_id % 10 = e.collection_id % 10")
def composite_key_lookup(spark, sf):
    e, i = entries(spark, sf), items(spark, sf)
    return e.withColumn("k", F.col("collection_id") % 10).join(i.withColumn("k", F.col("user_id") % 10), ["item_id", "k"]).select("collection_id", "item_id", "status")


@query("SELECT o_custkey AS user_id, CAST(count(DISTINCT o_orderkey % 1999) AS BIGINT) AS papers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def totals_by_user(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.countDistinct(F.col("o_orderkey") % 1999).alias("papers"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
