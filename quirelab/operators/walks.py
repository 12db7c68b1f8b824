"""Walks over the rows of groups in order, for choices that depend on those before them.

Rows are dealt by group and sorted by Spark, and a task reads them in batches, so that a group costs no call and no table of its
own, and of a group only what its step remembers is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from quirelab.session import ship


def walked(rows: DataFrame, group: str, order: Sequence[str | Column], reads: Sequence[str], begin: Callable[[], Callable], name: str, kind: DataType) -> DataFrame:
    """rows with the column `name`: what a step gives for the columns that it reads of each row; begin() makes a step for each group."""
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields]).add(name, kind)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            out = []
            for key, *values in zip(batch.column(group).to_pylist(), *(batch.column(c).to_pylist() for c in reads)):
                if step is None or key != current:
                    current, step = key, begin()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def within(budget: int) -> Callable[[], Callable]:
    """Whether a size still fits what is left of the budget; one that does not is passed over. A null size does not fit."""

    def begin() -> Callable:
        left = budget

        def step(size) -> bool:
            nonlocal left
            fits = size is not None and size <= left
            left -= size if fits else 0
            return fits

        return step

    return begin
