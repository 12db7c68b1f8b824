"""Queries on documents that the test tables do not hold, against their SQL: texts that are null, empty or without a plain character, null ids."""

import duckdb
import pytest

from quirelab.plans import catalog

ROWS = [(1, ""), (2, " \n"), (3, "É"), (4, "日本語 ###"), (5, None), (6, "A."), (7, "x"), (8, "\\us {a} ~ % <p> &amp; ]]> b"), (9, "a\x00b\rc\u0085d 😀"), (None, "no id"), (None, None), (-(2**62), "É, é")]


@pytest.mark.parametrize("name", ["jats_blocks", "latex_blocks"])
def test_odd_documents(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.columns == ["doc_id", "position", "section", "kind", "text"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(f"SELECT doc_id, position, section, kind, text FROM ({catalog.SQL[name]})").fetchall()
    assert sorted([tuple(r) for r in df.collect()], key=repr) == sorted(wanted, key=repr)
