"""The index of vectors against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.operators import neighbours as ops
from quirelab.operators import search


def found(rows):
    return {(r["query_id"], r["id"]): (r["similarity"], r["rank"]) for r in rows.collect()}


def test_recall_on_the_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = e.where("id % 20 = 0")
    index = ops.build(e, "id", "embedding")
    got, wanted = (found(f) for f in (ops.search(index, q, "id", "embedding", 10), search.nearest(q, e, "id", "embedding", 10)))
    assert len(got) == len(wanted) and len(got.keys() & wanted.keys()) >= 0.9 * len(wanted)
    assert all(abs(got[k][0] - wanted[k][0]) < 2e-6 for k in got.keys() & wanted.keys())
    # Every row is in the index, and all centres together find what a full comparison finds.
    assert index.table("members").count() == e.count() == sum(r["n"] for r in index.table("cells").collect())
    everything = found(ops.search(ops.load(spark, index.path), q, "id", "embedding", 10, visited=len(index.centres)))
    assert everything.keys() == wanted.keys()
    plan = ops.search(index, q, "id", "embedding", 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_clusters_need_few_visits(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 12))
    rows = [(k, (centres[k % 30] + 0.1 * rng.standard_normal(12)).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = ops.build(df, "id", "embedding")
    assert index.visited <= len(index.centres) / 4
    q = df.where("id % 20 = 0")
    got, wanted = (found(f).keys() for f in (ops.search(index, q, "id", "embedding", 10), search.nearest(q, df, "id", "embedding", 10)))
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_copies_odd_rows_and_filters(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 8))
    rows = [(k, base[k % 40].tolist()) for k in range(200)] + [(k, base[0].tolist()) for k in range(200, 400)]
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (504, []), (505, (base[1] * 1e200).tolist()), (506, (base[1] * 1e-200).tolist()), (7, base[7].tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("entry", F.lit("x")).withColumn("query", F.lit("x"))
    index = ops.build(df, "id", "embedding")
    sizes, ops.ENTRIES, ops.QUERIES = (ops.ENTRIES, ops.QUERIES), 16, 3
    try:
        got = [tuple(r) for r in ops.search(index, df, "id", "embedding", 3, visited=len(index.centres)).orderBy("query_id", "rank").collect()]
    finally:
        ops.ENTRIES, ops.QUERIES = sizes
    groups = {k: sorted({i for i, v in rows if v == base[k].tolist()} | ({505, 506} if k == 1 else set())) for k in range(40)}
    for q, i, s, rank in got:
        k = 1 if q in (505, 506) else 0 if 200 <= q < 400 else q % 40
        near = [x for x in groups[k] if x != q]
        if rank <= len(near):
            assert (i, s) == (near[rank - 1], pytest.approx(1)), (q, i, rank)
    assert {q for q, *_ in got} == {i for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    assert len(got) == 3 * len({q for q, *_ in got})
    allowed = spark.createDataFrame([(1,), (2,), (333,)], "id long")
    some = found(ops.search(index, df.where("id IN (0, 1)"), "id", "embedding", 5, visited=len(index.centres), allowed=allowed))
    assert {k for k in some if k[0] == 0} == {(0, 1), (0, 2), (0, 333)} and {k for k in some if k[0] == 1} == {(1, 2), (1, 333)} and some[0, 333] == (1.0, 1)
    none = ops.build(df.limit(0), "id", "embedding")
    assert ops.search(none, df, "id", "embedding", 3).count() == 0
    assert ops.search(index, df.limit(0), "id", "embedding", 3).count() == 0
    with pytest.raises(Exception, match="other lengths"):
        ops.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>"), "id", "v")
