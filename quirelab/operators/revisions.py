"""Alignment of two revisions of documents by the ids of their blocks.

Blocks with an id that stands once in either revision are matched. Where the matches of a document cross each other, the
alignment keeps a longest run of them that goes up on both sides; the others were moved, which counts as removed at the old
place and added at the new one. Matches are first cut where nothing crosses, so only tangled stretches need to be solved.

Cases: a document in one revision only is all removed or all added. Null ids and ids that stand several times in a revision
match nothing. A null document is a document. Equal positions are told apart by id. Of several longest runs the one is kept
that ends earliest in the new revision, and so on backwards. Empty revisions give no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelab.session import materialise, ship


def longest_rise(values: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence of different values, the least values that allow one."""
    ends: list[int] = []
    at: list[int] = []
    before = np.full(len(values), -1, np.int64)
    for k, v in enumerate(values.tolist()):
        p = bisect_left(ends, v)
        before[k] = at[p - 1] if p else -1
        if p == len(ends):
            ends.append(v)
            at.append(k)
        else:
            ends[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return np.array(out[::-1], np.int64)


def aligned(old: DataFrame, new: DataFrame, doc: str, block: str, position: str = "position") -> DataFrame:
    """(doc, block, old_position, new_position) of the blocks that keep their place in the order."""
    ship(old.sparkSession)
    once = lambda rows, name: rows.where(F.col(block).isNotNull()).groupBy(doc, block).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias(name)).where("_n = 1").drop("_n")
    a, b = once(old, "old_position"), once(new, "new_position").withColumnsRenamed({doc: "_doc", block: "_block"})
    pairs = a.join(b, a[doc].eqNullSafe(b["_doc"]) & (a[block] == b["_block"])).drop("_doc", "_block")
    # Ranks among the matches; a stretch ends where all ranks up to here stand up to here on the other side, too.
    by_old, by_new = (Window.partitionBy(doc).orderBy(c, block) for c in ("old_position", "new_position"))
    pairs = pairs.withColumn("_b", F.row_number().over(by_new)).withColumn("_a", F.row_number().over(by_old))
    pairs = pairs.withColumn("_ends", F.max("_b").over(by_old.rowsBetween(Window.unboundedPreceding, 0)) == F.col("_a"))
    pairs = pairs.withColumn("_stretch", F.count_if("_ends").over(by_old.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ends").cast("int"))
    sizes = Window.partitionBy(doc, "_stretch")
    pairs = pairs.withColumn("_size", F.count(F.lit(1)).over(sizes))
    columns = [doc, block, "old_position", "new_position"]

    def kept(stretches: pa.Table, ends: list[int]) -> pa.Table:
        new = stretches["_b"].to_numpy()
        places = [a + longest_rise(new[a:b]) for a, b in zip([0, *ends], ends)]
        return stretches.select(columns).take(pa.array(np.concatenate(places)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last stretch are held until another one begins.
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            keys = list(zip(batch.column(doc).to_pylist(), batch.column("_stretch").to_pylist()))
            begins = [k for k, (x, y) in enumerate(zip(keys, [last, *keys])) if y is not None and x != y]
            last = keys[-1] if keys else last
            table = pa.Table.from_batches([batch])
            if begins:
                n = sum(t.num_rows for t in held)
                done = pa.concat_tables([*held, table.slice(0, begins[-1])])
                yield from kept(done, [n + k for k in begins]).to_batches()
                held = []
            held.append(table.slice(begins[-1] if begins else 0))
        if n := sum(t.num_rows for t in held):
            yield from kept(pa.concat_tables(held), [n]).to_batches()

    straight, tangled = pairs.where("_size = 1").select(columns), pairs.where("_size > 1")
    schema = straight.schema
    rows = tangled.select(*columns, "_b", "_stretch", "_a").repartition(doc).sortWithinPartitions(doc, "_stretch", "_a")
    return straight.unionByName(rows.mapInArrow(solve, schema))


def aligned_diff(old: DataFrame, new: DataFrame, doc: str, block: str, content: str, position: str = "position") -> DataFrame:
    """(doc, block, old_position, new_position, change): unchanged and changed blocks of the alignment, and all others, removed
    or added."""
    # Read twice, so written once.
    pairs = materialise(aligned(old, new, doc, block, position), "aligned")
    a = old.select(F.col(doc), F.col(block), F.col(position).alias("old_position"), F.col(content).alias("_a"))
    b = new.select(F.col(doc).alias("_doc"), F.col(block).alias("_block"), F.col(position).alias("new_position"), F.col(content).alias("_b"))
    placed = pairs.select(F.col(doc).alias("_pdoc"), F.col(block).alias("_pblock"), "new_position")
    # An id that is matched stands once on either side, so id and document name its rows.
    left = a.join(placed, a[doc].eqNullSafe(placed["_pdoc"]) & (a[block] == placed["_pblock"]), "left").drop("_pdoc")
    b_of = b.withColumnRenamed("new_position", "_at")
    kept = left.where("_pblock IS NOT NULL").join(b_of, left[doc].eqNullSafe(b_of["_doc"]) & (left[block] == b_of["_block"]))
    change = F.when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    kept = kept.select(doc, block, "old_position", "new_position", change.alias("change"))
    removed = left.where("_pblock IS NULL").select(doc, block, "old_position", F.lit(None).cast(b.schema["new_position"].dataType).alias("new_position"), F.lit("removed").alias("change"))
    added = b.join(placed.select("_pdoc", "_pblock"), b["_doc"].eqNullSafe(placed["_pdoc"]) & (b["_block"] == placed["_pblock"]), "left_anti")
    added = added.select(F.col("_doc").alias(doc), F.col("_block").alias(block), F.lit(None).cast(a.schema["old_position"].dataType).alias("old_position"), "new_position", F.lit("added").alias("change"))
    return kept.union(removed).union(added)
