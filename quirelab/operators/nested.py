"""JSON texts of any depth: values of a key, and missing keys filled from another text.

Cases: null texts and texts that are not JSON hold no values and fill nothing; as a target such a text becomes the source's.
Values come in the order of their first place. Numbers are written with as few digits as their value needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.session import ship


def _read(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def _walk(value: object, keys: frozenset[str]) -> Iterator[str]:
    """Strings under the keys, alone or in arrays, anywhere in a value."""
    todo = [(False, value)]
    while todo:
        said, v = todo.pop()
        if isinstance(v, dict):
            todo += [(k in keys, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(said, x) for x in reversed(v)]
        elif said and isinstance(v, str) and v:
            yield v


def key_strings(rows: DataFrame, id_col: str, json_col: str, keys: Sequence[str]) -> DataFrame:
    """(id, place, value): the different non-empty strings under any of the keys, in order of their first place from 0."""
    ship(rows.sparkSession)
    wanted = frozenset(keys)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(_walk(_read(t), wanted))) for t in texts])

    return rows.select(id_col, F.posexplode(found(json_col)).alias("place", "value"))


def _filled(target: object, source: object) -> object:
    todo = [(target, source)]
    while todo:
        a, b = todo.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            todo += [(a[k], v) for k, v in b.items() if k in a]
            a.update((k, v) for k, v in b.items() if k not in a)
    return target


def filled_json(target: Column, source: Column) -> Column:
    """The target's JSON object with the keys of the source that it lacks, in nested objects, too; what it has stays, null too."""

    @F.pandas_udf("string")
    def fill(targets: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(targets, sources):
            a, b = _read(t), _read(s)
            out.append(None if a is None and b is None else json.dumps(b if a is None else _filled(a, b), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return fill(target, source)
