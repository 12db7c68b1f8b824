"""The streaming operators over the table events, run until its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.plans.model import SESSIONS
from quirelab.plans.registry import query
from quirelab.session import table
from quirelab.streaming import stateful
from quirelab.streaming import streams as ops


@query(f"WITH {SESSIONS} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(seconds) AS BIGINT) AS seconds FROM sessions GROUP BY 1")
def stream_weekly_buckets(spark, sf):
    return ops.run_once(ops.weekly_seconds(ops.read_events(spark, sf)), "weekly", "complete")


@query(f"WITH {SESSIONS} SELECT event_id, greatest(0, seconds - coalesce(lag(seconds) OVER (PARTITION BY user_id, kind ORDER BY event_id), 0)) AS delta FROM sessions")
def stream_heartbeat_delta(spark, sf):
    return ops.run_batches(ops.read_events(spark, sf), "heartbeats", ops.heartbeat_deltas)


@query(f"WITH {SESSIONS} SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) <= 3 AS allowed FROM sessions")
def stream_rate_limit(spark, sf):
    return ops.run_batches(ops.read_events(spark, sf), "limits", lambda fresh, state: ops.rate_limited(fresh, state, 86400, 3))


@query(f"WITH {SESSIONS} SELECT DISTINCT user_id, kind FROM sessions")
def stream_ttl_dedupe(spark, sf):
    return ops.run_once(ops.deduplicated(ops.read_events(spark, sf), ["user_id", "kind"], "60 days"), "dedupe").select("user_id", "kind")


@query(f"WITH {SESSIONS}, e AS (SELECT user_id AS job_id, event_id, CASE kind WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM sessions), t AS (SELECT job_id, min(event_id) AS last FROM e WHERE state IN ('succeeded', 'failed') GROUP BY job_id) SELECT e.job_id, event_id, state FROM e LEFT JOIN t USING (job_id) WHERE last IS NULL OR event_id <= last")
def stream_job_events(spark, sf):
    state = F.when(F.col("kind") == "purchase", "succeeded").when(F.col("kind") == "error", "failed").otherwise("running")
    return ops.run_once(ops.job_events(ops.read_events(spark, sf).select(F.col("user_id").alias("job_id"), "event_id", state.alias("state"))), "jobs")


@query(
    f"""WITH RECURSIVE {SESSIONS}, k(user_id, kind, ts) AS (SELECT user_id, kind, min(ts) FROM sessions GROUP BY user_id, kind UNION ALL
 SELECT k.user_id, k.kind, min(s.ts) FROM k JOIN sessions s ON s.user_id = k.user_id AND s.kind = k.kind AND s.ts >= k.ts + INTERVAL 7 DAY GROUP BY k.user_id, k.kind) SELECT user_id, kind, CAST(ts AS TIMESTAMP) AS ts FROM k"""
)
def stream_first_in_time(spark, sf):
    """De-duplication with a sliding time to live of seven days; keys are forgotten after it."""
    return ops.run_once(stateful.first_in_time(ops.read_events(spark, sf), ["user_id", "kind"], 7 * stateful.DAY), "first").select("user_id", "kind", "ts")


@query(
    f"""WITH {SESSIONS}, r AS (SELECT user_id, event_id AS reader, ts, event_id - 4000 AS last FROM sessions WHERE kind = 'error' AND seconds % 3 = 0),
 b AS (SELECT r.user_id, reader, e.event_id, e.kind, row_number() OVER (PARTITION BY reader ORDER BY e.event_id DESC) AS k, last FROM r JOIN sessions e ON e.user_id = r.user_id AND e.event_id <= r.reader)
 SELECT user_id, reader, event_id, kind, 'replay' AS how FROM b WHERE k <= 20 AND event_id > last UNION ALL
 SELECT r.user_id, reader, e.event_id, e.kind, 'live' FROM r JOIN sessions e ON e.user_id = r.user_id AND e.event_id > r.reader AND e.ts < r.ts + INTERVAL 1 DAY"""
)
def stream_event_log(spark, sf):
    """What readers of the users' logs of 20 events get, replayed and live; a reader comes after some of the errors."""
    events = ops.read_events(spark, sf)
    readers = ops.read_events(spark, sf).where("kind = 'error' AND seconds % 3 = 0").withColumn("last", F.col("event_id") - 4000)
    return ops.run_once(stateful.event_log(events, readers, size=20), "log").where("how <> 'ping'")


@query(
    f"""WITH {SESSIONS}, e AS (SELECT user_id AS job_id, event_id, CASE kind WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM sessions), j AS (SELECT c_custkey AS job_id, CASE WHEN c_nationkey % 5 = 0 THEN 'succeeded' ELSE 'queued' END AS state FROM customer),
 t AS (SELECT job_id, min(event_id) AS last FROM e WHERE state IN ('succeeded', 'failed') GROUP BY job_id)
 SELECT j.job_id, CAST(NULL AS BIGINT) AS event_id, j.state FROM j WHERE job_id IN (SELECT job_id FROM e) UNION ALL
 SELECT e.job_id, e.event_id, e.state FROM e LEFT JOIN j USING (job_id) LEFT JOIN t USING (job_id) WHERE coalesce(j.state, '') <> 'succeeded' AND (last IS NULL OR e.event_id <= last)"""
)
def stream_job_states(spark, sf):
    """Jobs' states so far from a table, then their events up to a terminal state."""
    state = F.when(F.col("kind") == "purchase", "succeeded").when(F.col("kind") == "error", "failed").otherwise("running")
    events = ops.read_events(spark, sf).select(F.col("user_id").alias("job_id"), "event_id", "ts", state.alias("state"))
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_nationkey") % 5 == 0, "succeeded").otherwise("queued").alias("state"))
    return ops.run_once(stateful.job_stream(events, jobs), "job-states")
