"""Stream operators whose state is a table: batches are continued, and no key costs a call of its own."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quirelab.streaming import streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def pieces(spark, tmp_path):
    """A stream that takes one piece of (event_id, hours, user_id, kind, seconds) a batch."""

    def make(*parts):
        folder = tmp_path / "in"
        folder.mkdir()
        schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("user_id", pa.int64()), ("kind", pa.string()), ("seconds", pa.int64())])
        for k, rows in enumerate(parts):
            columns = list(zip(*((i, None if h is None else START + dt.timedelta(hours=h), u, kind, s) for i, h, u, kind, s in rows)))
            pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema), folder / f"{k}.parquet")
            os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        return spark.readStream.schema("event_id long, ts timestamp, user_id long, kind string, seconds long").option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def test_rate_limit_goes_on_over_batches(pieces):
    stream = pieces(
        [(1, 1, 7, "x", 0), (2, 0, 7, "x", 0), (3, 2, None, "x", 0), (4, 3, 8, "x", 0)],
        [(5, 4, 7, "x", 0), (6, 25, 7, "x", 0), (7, 4, None, "x", 0), (8, 5, None, "x", 0)],
        [(9, 5, 8, "x", 0), (10, 26, 7, "x", 0), (11, 27, 7, "x", 0), (12, None, 9, "x", 0)],
    )
    found = streams.run_batches(stream, "limits", lambda fresh, state: streams.rate_limited(fresh, state, 86400, 2)).collect()
    # The ninth event is more than an hour older than the newest one before its batch.
    assert sorted(map(tuple, found)) == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, True), (7, True), (8, False), (10, True), (11, False), (12, True)]


def test_rate_limit_forgets_windows(spark):
    rows = lambda *r: spark.createDataFrame([(i, START + dt.timedelta(hours=h), u) for i, h, u in r], "event_id long, ts timestamp, user_id long")
    _, state = streams.rate_limited(rows((1, 1, 7), (2, 23, 8)), None, 86400, 2)
    out, later = streams.rate_limited(rows((3, 24.5, 7)), state, 86400, 2)
    assert sorted((r["user_id"], r["window"] - 19723, r["n"]) for r in later.collect()) == [(7, 0, 1), (7, 1, 1), (8, 0, 1)]
    _, last = streams.rate_limited(rows((4, 26, 9)), later, 86400, 2)
    assert sorted((r["user_id"], r["window"] - 19723, r["n"]) for r in last.collect()) == [(7, 1, 1), (9, 1, 1)]
    # Windows of Spark, without a call into Python for each user and window.
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()


def test_heartbeats_rise_over_batches(pieces):
    stream = pieces([(2, 0, 7, "x", 50), (1, 0, 7, "x", 20), (3, 0, 7, "y", 5), (4, 0, None, "x", 9)], [(5, 1, 7, "x", 80), (6, 1, 7, "x", 10), (7, 1, None, "x", 10)], [(8, 2, 7, "x", 12), (9, 2, 8, "x", None)])
    found = streams.run_batches(stream, "heartbeats", streams.heartbeat_deltas)
    assert sorted(map(tuple, found.collect())) == [(1, 20), (2, 30), (3, 5), (4, 9), (5, 30), (6, 0), (7, 1), (8, 2), (9, 0)]


def test_no_rows_no_results(pieces):
    assert streams.run_batches(pieces(), "heartbeats", streams.heartbeat_deltas).collect() == []
