"""Arrow batches in, Arrow batches out, a bounded slice of rows at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirelab.session import ship

#: Rows, and characters of text, that are held as Python objects at once (a single longer text stands alone).
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def settle() -> None:
    """Give memory that a finished task no longer needs back to the system; workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, columns: Sequence[str], schema: T.StructType, make: Callable[[], Callable[..., Sequence]], rows: int = SLICE_ROWS) -> DataFrame:
    """Run make()'s function over slices of the named columns; it gets a list for each column and returns one for each field of schema.

    make() is called once a task. A function with an attribute `finish` has it called after the last slice, for rows
    that sum up a partition.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        pack = lambda out: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)
        for batch in batches:
            for part in slices(batch, rows):
                out = call(*(c.to_pylist() for c in part.columns))
                if out is not None:
                    yield pack(out)
        for out in getattr(call, "finish", list)():
            yield pack(out)
        del call
        settle()

    return df.select(*(df[c] for c in columns)).mapInArrow(run, schema)
