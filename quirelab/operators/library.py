"""Filters, facets, sorting and paging over library items."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column | None]) -> Column:
    """AND over the given conditions; those that are None are not given."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def one_of(col: str, values: Sequence | None) -> Column | None:
    return F.col(col).isin(list(values)) if values else None


def contains_any_case(col: Column, needle: str, escape: bool = False) -> Column:
    """Case-insensitive containment; as LIKE patterns unless escape is set, so that % and _ in the needle match anything."""
    if escape:
        return F.contains(F.lower(col), F.lit(needle.lower()))
    return col.ilike(f"%{needle}%")


def uuid_or_null(col: Column) -> Column:
    low = F.lower(F.trim(col))
    return F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), low)


def merged_filter(saved: dict, given: dict) -> dict:
    """A saved filter's conditions, overridden by those that are given; None means not given."""
    return saved | {k: v for k, v in given.items() if v is not None}


def in_collection(items: DataFrame, entries: DataFrame, collections: Sequence) -> DataFrame:
    return items.join(entries.where(F.col("collection_id").isin(list(collections))), "item_id", "left_semi")


def sort_columns(key: str, descending: bool, id_col: str) -> list[Column]:
    """Nulls last in both directions, ties by id in the same direction."""
    return [F.col(key).desc_nulls_last(), F.col(id_col).desc()] if descending else [F.col(key).asc_nulls_last(), F.col(id_col).asc()]


def sorted_heads(rows: DataFrame, keys: dict[str, Column], id_col: str, n: int) -> DataFrame:
    """(sort, descending, place, id): the first n rows in each order. Each is a top-n of its own, so nothing is sorted whole."""
    heads = []
    for name, key in keys.items():
        for descending in (False, True):
            top = rows.select(key.alias("_k"), id_col).orderBy(*sort_columns("_k", descending, id_col)).limit(n)
            place = F.row_number().over(Window.orderBy(*sort_columns("_k", descending, id_col)))
            heads.append(top.select(F.lit(name).alias("sort"), F.lit(descending).alias("descending"), place.alias("place"), F.col(id_col)))
    return reduce(DataFrame.unionAll, heads)


def encode_cursor(key, row_id) -> str:
    return base64.urlsafe_b64encode(json.dumps([key, row_id], default=str).encode()).decode()


def decode_cursor(cursor: str) -> tuple:
    return tuple(json.loads(base64.urlsafe_b64decode(cursor.encode())))


def after_cursor(key: str, id_col: str, cursor: tuple, descending: bool) -> Column:
    """Rows after the cursor's row in sort_columns' order."""
    k, i = F.col(key), F.col(id_col)
    at, last = cursor
    beyond = i < F.lit(last) if descending else i > F.lit(last)
    if at is None:
        return k.isNull() & beyond
    further = k < F.lit(at) if descending else k > F.lit(at)
    return further | ((k == F.lit(at)) & beyond) | k.isNull()


def page(rows: DataFrame, key: str, id_col: str, limit: int, cursor: tuple | None = None, descending: bool = True) -> DataFrame:
    """One row more than limit, by which a caller sees whether there is a next page."""
    found = rows if cursor is None else rows.where(after_cursor(key, id_col, cursor, descending))
    return found.orderBy(*sort_columns(key, descending, id_col)).limit(limit + 1)


def facet(rows: DataFrame, col: str, values: Sequence) -> DataFrame:
    """(value, n) for every value of the list, 0 where none has it."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(v,) for v in values], "value string")
    counts = rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def top_tags(rows: DataFrame, col: str, limit: int, prefix: str = "") -> DataFrame:
    tags = rows.select(F.explode(col).alias("tag"))
    if prefix:
        tags = tags.where(F.startswith(F.lower("tag"), F.lit(prefix.lower())))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
