"""Choices in order: groups over batches, and no Python call for each group."""

import pytest

from quirelab.operators import anchors, layout, views


@pytest.fixture(autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def checked(df):
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan
    return sorted(map(tuple, df.collect()), key=str)


def test_line_paragraphs(spark):
    data = [(d, p, p // 4, 50.0 + (9 if p == 2 else 0), 40.0 + 14 * (p % 4), 12.0) for d in (1, 2, None) for p in range(8)] + [(3, 0, None, 50.0, 40.0, 12.0), (3, 1, None, 50.0, 54.0, 12.0), (3, 2, 0, 50.0, None, 12.0), (3, 3, 0, 50.0, 60.0, 12.0)]
    df = spark.createDataFrame(data, "doc_id long, position int, page int, x double, y double, height double")
    walk = [0, 0, 1, 1, 2, 2, 2, 2]
    assert checked(layout.paragraphs(df)) == sorted([(d, p, walk[p]) for d in (1, 2, None) for p in range(8)] + [(3, p, p) for p in range(4)], key=str)


def test_best_assignments(spark):
    data = [(d, a, b, s) for d in (1, None) for a, b, s in [(1, 1, 5), (1, 2, 5), (2, 1, 4), (2, 2, 3), (3, 2, 3), (3, 3, None)]]
    df = spark.createDataFrame(data, "doc_id long, a int, b int, score int")
    assert checked(anchors.assigned_pairs(df)) == sorted([(d, *x) for d in (1, None) for x in [(1, 1, 5), (2, 2, 3), (3, 3, None)]], key=str)


def test_slide_material(spark):
    data = [(d, p, kind, "x" * n) for d in (1, 2) for p, kind, n in [(0, "p", 6), (1, "h", 5), (2, "p", 3), (3, "other", 1), (4, "p", 1)]] + [(3, 0, "h", None), (3, 1, "h", "x")]
    df = spark.createDataFrame(data, "doc_id long, position int, kind string, text string")
    assert checked(views.slide_material(df, {"h": 0, "p": 1}, 9)) == [(d, p) for d in (1, 2) for p in (1, 2, 4)] + [(3, 1)]


def test_promoted_sections(spark):
    data = [(d, *x) for d in (1, 2) for x in [(0, False, 9, 5), (1, True, 0, 6), (2, False, 10, 5), (3, False, 1, 4), (4, False, 0, None)]]
    df = spark.createDataFrame(data, "doc_id long, section int, anchored boolean, matches int, tokens long")
    assert checked(anchors.promoted_sections(df, 10)) == [(d, s, s in (1, 3)) for d in (1, 2) for s in range(5)]
