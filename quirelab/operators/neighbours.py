"""Nearest neighbours through an index: an inverted file of vectors.

build() writes tables: centres (fitted on SAMPLE different vectors at most, those of the least hashes), cells (how many entries
a centre has), entries (each different vector's centre and its difference from it in bytes, partitioned by centre), vectors,
and members (which rows have a vector). It measures on the sample how many centres a query must visit for RECALL of its
neighbours: few where vectors form clusters, more than half where they point everywhere. search() visits the entries of a query's nearest centres only, ranks them by their bytes,
and computes exact cosines for the best of them. Every usable row is in the index; what search() can miss is a neighbour in
a centre that it does not visit.

Cases: null, zero or empty vectors and those with null or non-finite components are in no index and find nothing. A vector
of another length than the index's raises an error. Equal vectors are one entry, however many rows have them; of a large
group of equal vectors only the top_k + 1 least ids can be among the nearest. Ties go by id. A query's own row is not its
neighbour. Repeated ids count once in a result. An index of no vectors finds nothing; so do no queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelab.operators.search import dot
from quirelab.session import discard, fresh_path, materialise, ship

#: Vectors that centres are fitted on, and centres, at most.
SAMPLE, CENTRES = 20_000, 4096
#: Entries and queries on the two sides of a tile.
ENTRIES, QUERIES = 8192, 1024
#: Of the neighbours that sample vectors have in the sample, the share that must lie in visited centres; the vectors that are
#: asked for theirs, and how many neighbours of each.
RECALL, ASKED, NEIGHBOURS = 0.95, 500, 10
#: Candidates of a query whose cosines are computed exactly, times top_k.
RERANKED = 5
SEED = 29


@dataclass
class Index:
    spark: SparkSession
    path: str
    centres: np.ndarray
    #: Centres that a query visits.
    visited: int

    def table(self, name: str) -> DataFrame:
        # A partitioned table without rows has no files to tell its columns.
        reader = self.spark.read.schema("entry long, scale double, code binary, centre int") if name == "entries" else self.spark.read
        return reader.parquet(f"{self.path}/{name}")


def usable(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """The vector over its length, by the largest component first so that no square leaves the range."""
    over = lambda v, by: F.transform(F.array(by(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]
    # by(v) stands in an array of its own, so that it is computed once for each vector and not for each component.
    return F.transform(F.array(over(v, lambda v: F.array_max(F.transform(v, F.abs)))), lambda s: over(s, lambda s: F.sqrt(dot(s, s))))[0]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n)


def _mapped(df: DataFrame, schema: str, call: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                out = call(batch.slice(at, 4096))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def _nearest_centres(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each vector the n nearest centres, in any order."""
    far = (centres * centres).sum(1) - 2 * vectors @ centres.T
    return np.argpartition(far, min(n, len(centres)) - 1, axis=1)[:, :n]


def _needed_visits(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of centres to visit for RECALL of the sample's own neighbours. The sample is thinner than the table,
    so its neighbours are farther away and need rather more visits."""
    if len(sample) < 2:
        return 1
    asked = sample[: min(ASKED, len(sample))]
    likeness = asked @ sample.T
    np.fill_diagonal(likeness, -np.inf)
    top = np.argpartition(-likeness, min(NEIGHBOURS, len(sample) - 1) - 1, axis=1)[:, :NEIGHBOURS]
    far = lambda x: (centres * centres).sum(1) - 2 * x @ centres.T
    place = far(asked).argsort(1).argsort(1)
    visits = np.sort(np.take_along_axis(place, far(sample).argmin(1)[top], 1).ravel()) + 1
    return int(visits[min(len(visits) - 1, math.ceil(RECALL * len(visits)) - 1)])


def build(rows: DataFrame, id_col: str, vector_col: str, path: str | None = None, centres: int | None = None) -> Index:
    """An index over every usable row, at path (a folder of the shared one if none is given). centres: about the square root
    of the number of different vectors if none is given."""
    spark = rows.sparkSession
    path = path or fresh_path(spark, "neighbours")
    good = rows.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    first = good.select(F.size("vector")).first()
    n = first[0] if first else 0
    same = F.assert_true(F.size("vector") == n, F.lit(f"vectors of other lengths than {n}")).isNull()
    # Numbers are fixed once the table is written.
    vectors = materialise(good.where(same).select("vector").distinct().withColumn("entry", F.monotonically_increasing_id()).withColumn("unit", unit(F.col("vector"))), "vectors")
    found = vectors.count()
    k = min(centres or max(1, round(math.sqrt(found))), CENTRES)
    sample = materialise(vectors.orderBy(F.xxhash64("vector"), "entry").limit(SAMPLE).select("unit").repartition(spark.sparkContext.defaultParallelism), "sample")
    model = KMeans(k=k, seed=SEED, maxIter=10, initMode="random").fit(sample.select(array_to_vector("unit").alias("features"))) if found > 1 else None
    fitted = np.array(model.clusterCenters()) if model else np.zeros((1, n))
    visited = _needed_visits(np.array([r["unit"] for r in sample.collect()]), fitted)
    discard(sample)

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("unit"), n)
        centre = _nearest_centres(x, fitted, 1)[:, 0]
        rest = x - fitted[centre]
        scale = np.abs(rest).max(1) / 127
        codes = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
        return pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(centre.astype(np.int32)), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())], names=["entry", "centre", "scale", "code"])

    entries = _mapped(vectors.select("entry", "unit"), "entry long, centre int, scale double, code binary", coded)
    entries = materialise(entries, "coded")
    entries.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/cells")
    # Ranges of (centre, entry): a centre with very many entries is written by several tasks, a file has few centres.
    entries.repartitionByRange("centre", "entry").sortWithinPartitions("centre", "entry").write.partitionBy("centre").parquet(f"{path}/entries")
    good.join(vectors, "vector").select("entry", "id").write.parquet(f"{path}/members")
    vectors.select("entry", "unit").write.parquet(f"{path}/vectors")
    spark.createDataFrame([(k, visited, c.tolist()) for k, c in enumerate(fitted)], "centre int, visited int, place array<double>").write.parquet(f"{path}/centres")
    discard(entries)
    discard(vectors)
    return Index(spark, path, fitted, visited)


def load(spark: SparkSession, path: str) -> Index:
    places = spark.read.parquet(f"{path}/centres").orderBy("centre").collect()
    return Index(spark, path, np.array([r["place"] for r in places]), places[0]["visited"])


def _best(table: pa.Table, centres: np.ndarray, keep: int) -> pa.Table:
    """The best entries of a tile for each of its queries, by their bytes."""
    query = table["vector"].is_valid().to_numpy()
    asked, held = np.flatnonzero(query), np.flatnonzero(~query)
    names, owners, near = [], [], []
    if len(asked) and len(held):
        n = centres.shape[1]
        key = table["key"].to_numpy()
        centre = centres[table["centre"][0].as_py()]
        x = _matrix(table["vector"].combine_chunks().take(pa.array(asked)), n)
        codes = np.frombuffer(b"".join(table["code"].combine_chunks().take(pa.array(held)).to_pylist()), np.int8).reshape(len(held), n).astype(np.float32)
        scale = table["scale"].combine_chunks().take(pa.array(held)).to_numpy(zero_copy_only=False)
        for at in range(0, len(asked), 128):
            part = x[at : at + 128]
            likeness = (part.astype(np.float32) @ codes.T) * scale + (part @ centre)[:, None]
            top = np.argpartition(-likeness, min(keep, len(held)) - 1, axis=1)[:, :keep]
            owners.append(np.repeat(key[asked[at : at + 128]], top.shape[1]))
            names.append(key[held[top.ravel()]])
            near.append(np.take_along_axis(likeness, top, 1).ravel().astype(np.float64))
    join = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
    return pa.table({"query": join(owners, pa.int64()), "entry": join(names, pa.int64()), "likeness": join(near, pa.float64())})


def search(index: Index, queries: DataFrame, id_col: str, vector_col: str, top_k: int, visited: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the nearest rows of the index for each query row, but for the row of its own id.

    visited: centres that a query visits, if not as many as build() found to be needed. allowed: a table with a column id; other rows are no neighbours."""
    spark, centres = index.spark, index.centres
    visited = min(len(centres), visited or index.visited)
    n = centres.shape[1]
    asked = queries.where(usable(F.col(vector_col)) if n else F.lit(False)).select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    same = F.assert_true(F.size("vector") == n, F.lit(f"vectors of other lengths than {n}")).isNull()
    distinct = materialise(asked.where(same).select("vector").distinct().withColumn("query", F.monotonically_increasing_id()).withColumn("unit", unit(F.col("vector"))), "asked")

    def visits(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = _nearest_centres(_matrix(batch.column("unit"), n), centres, visited)
        rows = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
        return pa.RecordBatch.from_arrays([batch.column("query").take(rows), batch.column("unit").take(rows), pa.array(near.ravel().astype(np.int32))], names=["key", "vector", "centre"])

    to_visit = materialise(_mapped(distinct.select("query", "unit"), "key long, vector array<double>, centre int", visits), "visits")
    members = index.table("members")
    if allowed is not None:
        members = members.join(allowed.select("id").distinct(), "id", "left_semi")
    entries = index.table("entries")
    if allowed is not None:
        entries = entries.join(members.select("entry").distinct(), "entry", "left_semi")
    # Tiles: entries of a centre in chunks, its queries in blocks, every chunk with every block.
    sizes = index.table("cells").join(to_visit.groupBy("centre").agg(F.count(F.lit(1)).alias("q")), "centre").select("centre", F.ceil(F.col("n") / ENTRIES).cast("int").alias("chunks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("blocks"))
    sizes = F.broadcast(materialise(sizes, "sizes"))  # a row for each centre, so CENTRES at most
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = entries.select(F.col("entry").alias("key"), "centre", "scale", "code").join(sizes, "centre").withColumn("chunk", part("key", "chunks")).withColumn("block", every("blocks"))
    wanted = to_visit.join(sizes, "centre").withColumn("block", part("key", "blocks")).withColumn("chunk", every("chunks"))
    tiles = held.select("centre", "chunk", "block", "key", F.lit(None).cast("array<double>").alias("vector"), "scale", "code").unionByName(wanted.select("centre", "chunk", "block", "key", "vector", F.lit(None).cast("double").alias("scale"), F.lit(None).cast("binary").alias("code")))
    keep = RERANKED * top_k
    near = tiles.groupBy("centre", "chunk", "block").applyInArrow(lambda table: _best(table, centres, keep), "query long, entry long, likeness double")
    w = Window.partitionBy("query").orderBy(F.desc("likeness"), "entry")
    near = materialise(near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).select("query", "entry"), "candidates")
    exact = near.join(distinct.select("query", F.col("unit").alias("_q")), "query").join(index.table("vectors"), "entry").select("query", "entry", F.round(dot(F.col("_q"), F.col("unit")), 12).alias("_s"))
    # Of equal vectors only the least ids can be among the top_k, one of them may be the query's own.
    few = members.join(near.select("entry").distinct(), "entry", "left_semi").distinct()
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).where(F.col("_k") <= top_k + 1).drop("_k")
    w = Window.partitionBy("query").orderBy(F.desc("_s"), "id")
    heads = exact.join(few, "entry").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_k + 1).select("query", "id", "_s")
    heads = materialise(heads, "heads")
    owners = asked.join(distinct.select("vector", "query"), "vector").select("query_id", "query").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "id")
    out = owners.join(heads, "query").where("query_id <> id").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)
    for used in (to_visit, near):
        discard(used)
    return out.select("query_id", F.col("id").alias(id_col), F.round("_s", 6).alias("similarity"), "rank")
