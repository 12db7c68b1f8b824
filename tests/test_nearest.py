"""Exact neighbours in tiles against the plain product of all pairs."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelab.operators import search


def plain(queries, rows, top_k):
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(F.sqrt(search.dot(v, v)), F.lit(0.0)), F.lit(1.0)))
    a, b = queries.select(F.col("id").alias("query_id"), unit(F.col("v")).alias("_q")), rows.select("id", unit(F.col("v")).alias("v"))
    pairs = a.crossJoin(b).where("query_id <> id").withColumn("_s", search.dot(F.col("_q"), F.col("v")))
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k).select("query_id", "id", F.round("_s", 6).alias("similarity"), "rank")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_vectors_and_ties(spark, monkeypatch, kind):
    monkeypatch.setattr(search, "ROWS", 40)
    monkeypatch.setattr(search, "QUERIES", 7)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    odd = [None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 4.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1e308] * 5]
    data = [(k, base[k % 12] if k % 3 else [x * 2 for x in base[k % 12]]) for k in range(150)] + [(200 + k, v) for k, v in enumerate(odd)] + [(None, base[0])]
    df = spark.createDataFrame(data, "id long, v array<float>").withColumn("id", F.col("id").cast(kind))
    queries = df.where("id % 10 = 0 OR id >= 200 OR id IS NULL")
    got, wanted = (sorted(map(str, x.collect())) for x in (search.nearest(queries, df, "id", "v", 6), plain(queries, df, 6)))
    assert got == wanted


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, None)], "id int, v array<double>")
    assert sorted(map(tuple, search.nearest(df.where("id = 1"), df, "id", "v", 5).collect())) == [(1, 2, 1.0, 1), (1, 3, None, 2)]
    assert search.nearest(df.where("id = 9"), df, "id", "v", 5).collect() == []


def test_many_pairs_in_little_time(spark):
    vectors = np.random.default_rng(5).normal(size=(20_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(20_000), "v": vectors.tolist()}), "id long, v array<float>").repartition(4)
    search.nearest(df.where("id < 5"), df, "id", "v", 10).count()
    begin = time.monotonic()
    found = search.nearest(df.where("id % 8 = 0"), df, "id", "v", 10).where("query_id = 80 AND rank = 1").collect()
    assert time.monotonic() - begin < 40
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    s = unit @ unit[80]
    s[80] = -1
    assert found[0]["id"] == int(s.argmax())
