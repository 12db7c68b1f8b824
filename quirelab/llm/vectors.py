"""Near copies among vectors by a subspace pigeonhole join.

Vectors are scaled to unit length and rotated at random; a cosine of at least c is a squared distance of at most 2 - 2c.
The rotated axes are split into blocks of a few dimensions. If a pair's squared distance is within the limit, then in at
least one block its share is within that block's part of the limit, in proportion to the block's dimensions. Each block is
range-joined under its part: a grid over the block's first AXES axes deals vectors into cells twice as wide as the radius, and
a vector also stands in the next cell of each axis whose border is within the radius, so that a pair within the radius meets.

Only the block's values are dealt first. They tell which members of a tile have a candidate, that is a partner within the
block's budget; only those come together again as whole vectors, and the cosine of each candidate is computed in double
precision. A pair is counted in the first block that proposes it, so that the union over blocks needs no table of pairs: a
tile returns link counts and a spanning star of what it linked.

Equal vectors of a label are one class with a count. Tiles hold at most about TILE vectors on either side, whatever a cell
holds.

Cases: vectors link only where labels are equal and not null and lengths are equal; a null, empty or zero vector, or one with
a null or non-finite component, links with nothing and is its own component. Rows with the same id stand for vectors of their
own. A null id is kept and never a component's id unless all its ids are null. Columns besides the three named are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quirelab.llm.graph import components
from quirelab.llm.rows import map_rows
from quirelab.session import discard, materialise, ship

BLOCKS, AXES, TILE, SEED = 8, 3, 2000, 17
#: Cells with more than a tile's vectors, up to which their counts are broadcast (each below 100 bytes).
BROADCAST_CELLS = 200_000
#: By how much squared distances of block values in single precision may be off.
SINGLE = 1e-5
#: What distances and sums of squares may be off by in double precision.
ROUNDING = 1e-9


@lru_cache(maxsize=16)
def rotation(n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """An orthogonal matrix for vectors of n components, and the axes of each block."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, n)).standard_normal((n, n)))
    return q * np.sign(np.diag(r)), np.array_split(np.arange(n), min(BLOCKS, n))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither vanish nor overflow.
    big = np.abs(vectors).max(1, keepdims=True)
    v = vectors / np.where(big > 0, big, 1)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _budget(limit: float, axes: int, n: int) -> float:
    return limit * axes / n * (1 + ROUNDING) + 1e-12


def _dealt(lengths: list[int], vectors: list, limit: float):
    """For each cell of each block that a vector stands in: the vector's place in the list, the block, the cell, a bit for each
    axis on which it is not the vector's own cell, and the block's values (single precision, as bytes)."""
    found = []
    by_length: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        by_length.setdefault(n, []).append(k)
    for n, rows in by_length.items():
        q, blocks = rotation(n)
        rotated = _unit(np.array([vectors[k] for k in rows], np.float64)) @ q
        for b, axes in enumerate(blocks):
            values = rotated[:, axes]
            radius = math.sqrt(limit * len(axes) / n) * (1 + 1e-6) + 1e-7
            at, halo, cells = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros((len(rows), 0), np.int64)
            for axis in range(AXES):
                if axis >= len(axes):
                    cells = np.column_stack([cells, np.zeros(len(at), np.int64)])
                    continue
                x = values[at, axis] / (2 * radius)
                own = np.floor(x).astype(np.int64)
                near = np.flatnonzero(own + 1 - x <= 0.5)
                cells = np.column_stack([np.concatenate([cells, cells[near]]), np.concatenate([own, own[near] + 1])])
                at, halo = np.concatenate([at, at[near]]), np.concatenate([halo, halo[near] | 1 << axis])
            single = np.zeros((len(rows), len(blocks[0])), np.float32)
            single[:, : len(axes)] = values
            found.append((np.array(rows)[at], np.full(len(at), b), cells, halo, [x.tobytes() for x in single], at))
    if not found:
        return None
    place, block, cells, halo = (np.concatenate(x) for x in list(zip(*found))[:4])
    return place, block, cells, halo, [values[k] for *_, values, at in found for k in at.tolist()]


def _meeting(table: pa.Table, limit: float) -> np.ndarray:
    """Which members of a tile have a partner there within the block's budget."""
    i, j, b, n = (table[c][0].as_py() for c in ("i", "j", "block", "length"))
    nodes, halo, chunk = (table[c].to_numpy() for c in ("node", "halo", "chunk"))
    x = np.frombuffer(b"".join(table["part"].to_pylist()), np.float32).reshape(len(nodes), -1)
    budget = _budget(limit, len(rotation(n)[1][b]), n) + SINGLE
    # One product gives minus half the squared distance.
    half, one = -0.5 * (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
    u, v = np.hstack([x, half, one]), np.hstack([x, one, half])
    met = np.zeros(len(nodes), bool)
    axis, radius = min(AXES, x.shape[1] - 1), math.sqrt(budget) + 1e-4
    left, right = (rows[x[rows, axis].argsort(kind="stable")] for rows in (np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)))
    along, vr = x[right, axis], np.ascontiguousarray(v[right].T)
    for at in range(0, len(left), 128):
        xs = left[at : at + 128]
        low, high = np.searchsorted(along, x[xs[0], axis] - radius), np.searchsorted(along, x[xs[-1], axis] + radius, "right")
        flat = np.flatnonzero(u[xs] @ vr[:, low:high] >= -0.5 * budget)
        if not len(flat):
            continue
        px, py = xs[flat // (high - low)], right[low + flat % (high - low)]
        ok = (halo[px] & halo[py] == 0) & (nodes[px] != nodes[py])
        met[px[ok]] = True
        met[py[ok]] = True
    return met


def _tile(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links in this tile, the rows they link with, and the least node that they are linked to here."""
    b, i, j = table["block"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
    nodes, copies, halo = (table[c].to_numpy() for c in ("node", "copies", "halo"))
    chunk = table["chunk"].to_numpy()
    vectors = table["vector"].combine_chunks()
    vectors = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(nodes), -1)
    n = vectors.shape[1]
    limit = 2 - 2 * cosine
    q, blocks = rotation(n)
    rotated = _unit(vectors) @ q
    # Powers of two leave the digits as they are and keep the squares within range.
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    links = np.zeros(len(nodes), np.int64)
    group = np.arange(len(nodes))

    def budget(k: int) -> float:
        return _budget(limit, len(blocks[k]), n)

    def share(k: int, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        d = rotated[xs][:, blocks[k]] - rotated[ys][:, blocks[k]]
        return (d * d).sum(1)

    def near(k: int, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        u, v = rotated[np.ix_(xs, blocks[k])], rotated[np.ix_(ys, blocks[k])]
        return (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * u @ v.T <= budget(k) + ROUNDING

    # Both sides in the order of the block's last axis, on which a pair is no farther apart than the radius either.
    axis, radius = blocks[b][-1], math.sqrt(budget(b)) + 1e-7
    left, right = (x[rotated[x, axis].argsort(kind="stable")] for x in (left, right))
    along = rotated[right, axis]
    for at in range(0, len(left), 128):
        xs = left[at : at + 128]
        ys = right[np.searchsorted(along, rotated[xs[0], axis] - radius) : np.searchsorted(along, rotated[xs[-1], axis] + radius, "right")]
        p, o = np.nonzero(near(b, xs, ys))
        px, py = xs[p], ys[o]
        keep = halo[px] & halo[py] == 0
        if i == j:
            keep &= nodes[px] < nodes[py]
        px, py = px[keep], py[keep]
        if not len(px):
            continue
        # A pair belongs to the first block that proposes it.
        keep = share(b, px, py) <= budget(b)
        for k in range(b):
            keep[keep] = share(k, px[keep], py[keep]) > budget(k)
        px, py = px[keep], py[keep]
        x, y = scaled[px], scaled[py]
        exact = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        linked = exact >= cosine
        px, py = px[linked], py[linked]
        np.add.at(links, px, copies[py])
        np.add.at(links, py, copies[px])
        ends = np.flatnonzero(np.diff(px, append=-1)) + 1
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            joined = np.unique(group[np.append(py[start:end], px[start])])
            if len(joined) > 1:
                group[np.isin(group, joined)] = joined[0]
    some = np.flatnonzero(links)
    tops, which = np.unique(group[some], return_inverse=True)
    least = np.full(len(tops), np.iinfo(np.int64).max)
    np.minimum.at(least, which, nodes[some])
    return nodes[some], links[some], least[which]


def near_copies(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row: id, n_links (other rows linked directly), component_id, kept."""
    ship(vectors.sparkSession)
    limit = 2 - 2 * cosine
    v = F.col("vector")
    usable = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    good = rows.where("ok")
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # Numbers are fixed once the table is written.
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vectors")

    cell = ["label", "length", "block", "c0", "c1", "c2"]
    long = lambda name: T.StructField(name, T.LongType())
    dealt_schema = T.StructType([classes.schema["label"], T.StructField("length", T.IntegerType()), *map(long, ("block", "c0", "c1", "c2", "node", "halo")), T.StructField("part", T.BinaryType())])

    def dealt(with_values: bool):
        def make():
            def call(labels, lengths, nodes, vectors):
                out = _dealt(lengths, vectors, limit)
                if out is None:
                    return None
                place, block, cells, halo, parts = out
                take = lambda x, t: pa.array(x, t).take(pa.array(place))
                return take(labels, label_type), take(lengths, pa.int32()), pa.array(block), *(pa.array(np.ascontiguousarray(c)) for c in cells.T), take(nodes, pa.int64()), pa.array(halo), pa.array(parts if with_values else [None] * len(place), pa.binary())

            return call

        return map_rows(classes, ["label", "length", "node", "vector"], dealt_schema, make)

    label_type = to_arrow_type(classes.schema["label"].dataType)
    sizes = dealt(False).groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    sizes = materialise(sizes.withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int")).drop("n"), "cells")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    chunked = dealt(True).join(sizes, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    tiles = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    tile_key = [*cell, "i", "j"]
    kept_columns = [*tile_key, "node", "halo", "chunk"]
    tiles = tiles.select(*kept_columns, "part")

    def members(table: pa.Table) -> pa.Table:
        return table.select(kept_columns).filter(pa.array(_meeting(table, limit)))

    kept = materialise(tiles.groupBy(*tile_key).applyInArrow(members, tiles.drop("part").schema), "meeting-vectors")
    tiles = kept.join(classes.select("node", "copies", "vector"), "node")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        nodes, links, roots = _tile(table, cosine)
        return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})

    found = materialise(tiles.groupBy(*tile_key).applyInArrow(run, schema), "vector-links")
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = classes.select("node", "label", "vector", "id", "copies").join(links, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_node = materialise(by_node, "vector-classes")
    least = by_node.groupBy("component").agg(F.min("id").alias("component_id"))
    # Only classes that differ from a single unlinked row need to be told.
    told = by_node.join(least, "component").where("copies > 1 OR links > 0").select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    told = materialise(told, "vector-told")
    out = rows.join(told, ["label", "vector"], "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    for used in (kept, found, reached, classes, by_node):
        discard(used)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
