"""Queries of the export and import formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.plans.model import ITEMS, PAPERS, items, papers
from quirelab.plans.registry import query
from quirelab.session import table
from quirelab.sources import exports as ops


@query(f"WITH {ITEMS} SELECT CAST(item_id AS VARCHAR) AS item_id, status, coalesce(priority, '') AS priority, coalesce(CAST(deadline AS VARCHAR), '') AS deadline, printf('%.2f', price) AS price FROM items")
def export_csv_rows(spark, sf):
    return ops.csv_rows(items(spark, sf).select("item_id", "status", "priority", "deadline", "price"))


@query(
    f"""WITH {PAPERS}, b AS (SELECT paper_id, regexp_replace(lower(tags[-1]), '[^a-z0-9]', '', 'g') || coalesce(CAST(year AS VARCHAR), 'nd') AS base FROM papers), k AS (SELECT paper_id, base, row_number() OVER (PARTITION BY base ORDER BY paper_id) AS n FROM b)
 SELECT paper_id, base || CASE WHEN n <= 1 THEN '' WHEN n - 2 < 26 THEN chr(CAST(97 + n - 2 AS INTEGER)) ELSE chr(CAST(97 + (n - 2) // 26 - 1 AS INTEGER)) || chr(CAST(97 + (n - 2) % 26 AS INTEGER)) END AS cite_key FROM k"""
)
def bibtex_keys(spark, sf):
    named = papers(spark, sf).withColumn("surname", F.element_at("tags", -1))
    return ops.bibtex_keys(named, "paper_id", "surname", "year").select("paper_id", "cite_key")


@query(f"WITH {PAPERS} SELECT paper_id, '@article{{k' || paper_id || ',' || chr(10) || '  title = {{' || title || '}}' || CASE WHEN year IS NULL THEN '' ELSE ',' || chr(10) || '  year = {{' || year || '}}' END || chr(10) || '}}' AS entry FROM papers")
def bibtex_entries(spark, sf):
    key = F.concat(F.lit("k"), F.col("paper_id").cast("string"))
    return papers(spark, sf).select("paper_id", ops.bibtex_entry(key, F.lit("article"), {"title": F.col("title"), "year": F.col("year").cast("string")}).alias("entry"))


@query("SELECT item_id || chr(9) || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(9), ' '), chr(10), '<br>') AS line FROM benchmark")
def vocabulary_tsv(spark, sf):
    return table(spark, sf, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), ops.tsv_field(F.col("text"))).alias("line"))


@query("SELECT conv_id, string_agg('- **' || role || '**: ' || regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def thread_markdown(spark, sf):
    return ops.markdown_notes(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT doc_id AS page, 0 AS side FROM documents WHERE doc_id % 3 <> 1 UNION SELECT doc_id, 1 FROM documents WHERE doc_id % 4 <> 2")
def interleaved_pages(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page"))
    return ops.interleaved_pages(d.where("page % 3 <> 1"), d.where("page % 4 <> 2"), "page")


@query("WITH g AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey END AS id FROM part), e AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 1) SELECT CASE WHEN g.id IS NULL THEN 'failed' WHEN e.id IS NOT NULL THEN 'skipped' ELSE 'created' END AS status, count(*) AS n FROM g LEFT JOIN e ON e.id = g.id GROUP BY 1")
def restore_counts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return ops.restore(p.where("id % 4 = 1"), p.select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("id")), ["id"])


@query("SELECT source AS asset, sha256(min(text)) AS sha256, CAST(strlen(min(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY source")
def asset_manifest(spark, sf):
    return ops.manifest(table(spark, sf, "documents").withColumnRenamed("source", "asset"), "asset", "text")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations")
def dump_counts(spark, sf):
    parts = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "orders", "events", "conversations")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
