"""Filtering whole rows by a decision about one text column, and adding columns that are told from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirelab.llm.rows import settle, slices
from quirelab.session import ship


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of df, with all their columns, whose text make()'s function says True of; no shuffle, and no need for an id."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part in slices(batch):
                keep = part.filter(pa.array(call(part.column(at).to_pylist()), pa.bool_()))
                if keep.num_rows:
                    yield keep
        del call
        settle()

    return df.mapInArrow(run, df.schema)


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """df with a column for each field, which make()'s function gives for a list of texts; the names must not be df's."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema, *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part in slices(batch):
                found = [pa.array(x, f.type) for x, f in zip(call(part.column(at).to_pylist()), arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *arrow.names])
        del call
        settle()

    return df.mapInArrow(run, schema)
