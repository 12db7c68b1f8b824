"""Running sums and digests over the rows of a key, where a key may have very many rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.llm.rows import settle, slices
from quirelab.session import discard, materialise, ship

#: Characters that are hashed as one row.
CHUNK = 1 << 16


def in_order(df: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with a running sum of value (exclusive) over the rows of a key in an order, as a written table.

    Rows are dealt by ranges of (key, order), so a key with very many rows is spread over tasks; what stands before a range
    is added from a table that has a row at most for each range.
    """
    ship(df.sparkSession)
    ranged = df.withColumn("_value", value).repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    at_key, at_value, at_range = (ranged.columns.index(c) for c in (key, "_value", "_range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, first = None, 0, True
        for batch in batches:
            before, opening = [], []
            for k, v in zip(batch.column(at_key).to_pylist(), batch.column(at_value).to_pylist()):
                if first or k != last:
                    opening_now = first
                    last, total, first = k, 0, False
                    in_first = opening_now
                before.append(total)
                opening.append(in_first)
                total += v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(opening, pa.bool_())], names=[*batch.schema.names, "_before", "_opening"])

    summed = materialise(ranged.mapInArrow(run, f"{fields}, _before long, _opening boolean"), "ranged")
    # Only the first key of a range can have rows in earlier ranges: the last sums of all ranges of those keys.
    ends = summed.groupBy(key, "_range").agg(F.max(F.col("_before") + F.col("_value")).alias("_sum"))
    opening = summed.where("_opening").select(key, "_range").distinct()
    ends = ends.join(opening.select(key).distinct(), key)
    before = ends.withColumn("_earlier", F.sum("_sum").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.join(opening, [key, "_range"]).where("_earlier > 0").select(key, "_range", "_earlier")
    out = summed.join(F.broadcast(before), [key, "_range"], "left").withColumn(name, F.col("_before") + F.coalesce("_earlier", F.lit(0)))
    out = materialise(out.select(*df.columns, name), "ordered")
    discard(summed)
    return out


def hashed(parts: DataFrame, key: list[str], order: str, text: Column, name: str, between: str = "") -> DataFrame:
    """key, name: lower-case SHA-256 of the texts of a key in the order of a column.

    Texts of neighbouring rows are joined in pieces within ranges of (key, order) first, so that the pass over a key, which a
    digest needs, reads few and long rows and holds one of them.
    """
    ship(parts.sparkSession)
    width, chunk = len(key), CHUNK
    rows = parts.select(*key, F.col(order).alias("_order"), text.alias("_text")).repartitionByRange(*key, "_order").sortWithinPartitions(*key, "_order")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The piece that is still growing: its key, its order, its texts and their length.
        now, at, texts, size = None, None, [], 0
        for batch in batches:
            out = []
            for part in slices(batch):
                columns = [c.to_pylist() for c in part.columns]
                for *k, o, t in zip(*columns):
                    if k != now or size > chunk:
                        if now is not None:
                            out.append((*now, at, between.join(texts)))
                        now, at, texts, size = k, o, [], 0
                    texts.append(t)
                    size += len(t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), batch.schema)], schema=batch.schema)
            schema = batch.schema
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, at, between.join(texts)), schema)], schema=schema)
        settle()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, schema = None, None, None
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            out = []
            schema = pa.schema([*(batch.schema.field(k) for k in range(width)), pa.field(name, pa.string())])
            for part in slices(batch):
                for *k, _, t in zip(*(c.to_pylist() for c in part.columns)):
                    if k != now:
                        if now is not None:
                            out.append((*now, state.hexdigest()))
                        now, state = k, hashlib.sha256(t.encode("utf-8", "surrogatepass"))
                    else:
                        state.update((between + t).encode("utf-8", "surrogatepass"))
            if out:
                yield pack(out)
        if now is not None:
            yield pack([(*now, state.hexdigest())])
        settle()

    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in list(rows.schema)[:width])
    joined = rows.mapInArrow(pieces, fields)
    return joined.repartition(*key).sortWithinPartitions(*key, "_order").mapInArrow(digests, f"{key_fields}, `{name}` string")
