"""Every query that has SQL gives DuckDB's rows on the same tables; the others give rows of a stable schema."""

import math

import duckdb
import pytest

from quirelab.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)[:19].replace("T", " ") if hasattr(v, "isoformat") else str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    found = table_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(catalog.SQL[name])
    wanted = table_of([d[0] for d in r.description], r.fetchall())
    assert found == wanted


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_rows_without_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score", "hits"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
