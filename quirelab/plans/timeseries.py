"""Queries over sessions, usage, reviews and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelab.operators import timeseries as ops
from quirelab.operators.library import best_per_key
from quirelab.plans.model import SESSIONS, sessions
from quirelab.plans.registry import query


@query(f"WITH {SESSIONS}, w AS (SELECT CAST(DATE '2024-01-29' - CAST(7 * (11 - i) AS INTEGER) AS DATE) AS week FROM range(12) t(i)), s AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, sum(seconds) AS s FROM sessions GROUP BY 1) SELECT week, round_even(coalesce(CAST(s AS BIGINT), 0) / 3600, 1) AS hours FROM w LEFT JOIN s USING (week)")
def weekly_buckets(spark, sf):
    return ops.weekly_hours(sessions(spark, sf), "2024-02-02")


@query(f"WITH {SESSIONS} SELECT user_id, count(*) FILTER (WHERE kind = 'purchase' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22') AS finished FROM sessions GROUP BY user_id")
def finished_this_week(spark, sf):
    week = (F.col("ts") >= "2024-01-15") & (F.col("ts") < "2024-01-22")
    return sessions(spark, sf).groupBy("user_id").agg(F.count_if(week & (F.col("kind") == "purchase")).alias("finished"))


@query(f"WITH {SESSIONS} SELECT user_id, CAST(coalesce(sum(seconds) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-10'), 0) AS BIGINT) // 60 AS minutes FROM sessions GROUP BY user_id")
def minutes_today(spark, sf):
    today = F.sum(F.when(F.col("ts").cast("date") == F.lit("2024-01-10").cast("date"), F.col("seconds")))
    return sessions(spark, sf).groupBy("user_id").agg(F.floor(F.coalesce(today, F.lit(0)) / 60).cast("long").alias("minutes"))


@query(
    f"""WITH {SESSIONS}, l(kind, quota) AS (VALUES ('click', 30), ('view', 500), ('purchase', 20), ('signup', 30), ('error', 300)), u AS (SELECT user_id, kind, count(*) AS used FROM sessions WHERE date_trunc('month', ts + INTERVAL 9 HOUR) = TIMESTAMP '2024-01-01' GROUP BY user_id, kind)
 SELECT user_id, u.kind, used, CAST(quota AS INTEGER) AS quota, used > quota AS exceeded FROM u JOIN l ON l.kind = u.kind"""
)
def monthly_quota(spark, sf):
    month = ops.month_in("Asia/Tokyo", F.col("ts").cast("timestamp"))
    used = sessions(spark, sf).where(month == F.lit("2024-01-01").cast("date")).groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("used"))
    quota = F.broadcast(spark.createDataFrame(list(ops.MONTHLY_LIMITS.items()), "kind string, quota int"))
    return used.join(quota, "kind").select("user_id", "kind", "used", "quota", (F.col("used") > F.col("quota")).alias("exceeded"))


@query("SELECT user_id, CAST(50 - sum(CAST(value AS DECIMAL(12,4))) AS DOUBLE) AS remaining FROM events GROUP BY user_id")
def budget_remaining(spark, sf):
    from quirelab.session import table

    spent = F.sum(F.col("value").cast("decimal(12,4)"))
    return table(spark, sf, "events").groupBy("user_id").agg((F.lit(50) - spent).cast("double").alias("remaining"))


@query(f"WITH {SESSIONS} SELECT event_id, greatest(0, seconds - coalesce(lag(seconds) OVER (PARTITION BY user_id, kind ORDER BY event_id), 0)) AS delta FROM sessions")
def heartbeat_delta(spark, sf):
    return ops.heartbeats(sessions(spark, sf), ["user_id", "kind"], "event_id", "seconds").select("event_id", "delta")


@query(f"WITH {SESSIONS} SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) <= 3 AS allowed FROM sessions")
def rate_limit_windows(spark, sf):
    return ops.rate_limited(sessions(spark, sf), "user_id", "ts", 86400, 3, "event_id").select("event_id", "allowed")


@query(
    f"""WITH RECURSIVE {SESSIONS}, k(user_id, kind, ts) AS (SELECT user_id, kind, min(ts) FROM sessions GROUP BY user_id, kind UNION ALL
 SELECT k.user_id, k.kind, min(s.ts) FROM k JOIN sessions s ON s.user_id = k.user_id AND s.kind = k.kind AND s.ts >= k.ts + INTERVAL 7 DAY GROUP BY k.user_id, k.kind) SELECT user_id, kind, ts FROM k"""
)
def ttl_dedupe(spark, sf):
    return ops.ttl_deduplicated(sessions(spark, sf), ["user_id", "kind"], "ts", 7, "event_id").select("user_id", "kind", "ts")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type <> 'error' AS good FROM events WHERE event_type IN ('error', 'click', 'view')),
 s(user_id, k, stage, mastered) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 1, false FROM e UNION ALL SELECT e.user_id, e.k, CASE WHEN NOT good THEN 1 WHEN s.mastered OR s.stage >= 5 THEN 5 ELSE s.stage + 1 END, good AND (s.mastered OR s.stage >= 5) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1),
 l AS (SELECT user_id, max(k) AS n, arg_max(stage, k) AS stage, arg_max(mastered, k) AS mastered FROM s GROUP BY user_id)
 SELECT user_id, CAST(n AS INTEGER) AS n, stage, mastered, CASE WHEN NOT mastered THEN CAST(DATE '2024-02-01' + CASE stage WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 14 ELSE 30 END AS DATE) END AS next_review FROM l"""
)
def srs_replay(spark, sf):
    reviews = sessions(spark, sf).where("kind IN ('error', 'click', 'view')")
    history = reviews.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("kind") != "error").alias("good")))).alias("h"))
    state = ops.replay_reviews(F.transform("h", lambda x: x["good"]))
    rows = history.select("user_id", state.alias("s")).select("user_id", "s.n", "s.stage", "s.mastered")
    return rows.withColumn("next_review", ops.next_review(F.lit("2024-02-01").cast("date"), F.col("stage"), F.col("mastered")))


@query(f"WITH {SESSIONS}, u AS (SELECT user_id, kind, CASE WHEN user_id % 3 = 0 THEN 'planned' WHEN user_id % 3 = 1 THEN 'reading' ELSE 'done' END AS status, CAST(sum(seconds) AS BIGINT) AS seconds, max(seconds) > 400 AS ended FROM sessions GROUP BY user_id, kind) SELECT user_id, kind, CASE WHEN status IN ('planned', 'up_next') AND seconds >= 180 THEN 'reading' WHEN status = 'reading' AND ended THEN 'done' END AS suggestion FROM u")
def status_suggestions(spark, sf):
    status = F.when(F.col("user_id") % 3 == 0, "planned").when(F.col("user_id") % 3 == 1, "reading").otherwise("done")
    rows = sessions(spark, sf).groupBy("user_id", "kind").agg(F.sum("seconds").alias("seconds"), (F.max("seconds") > 400).alias("ended"))
    return rows.select("user_id", "kind", ops.suggested_status(status, F.col("seconds"), F.col("ended")).alias("suggestion"))


@query(f"WITH {SESSIONS} SELECT event_id, CASE WHEN seconds % 2 = 0 THEN 'succeeded' WHEN event_id % 4 + 1 >= 4 THEN 'failed' ELSE 'queued' END AS state, CAST(CASE WHEN seconds % 2 = 1 THEN CASE event_id % 4 + 1 WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 480 END END AS INTEGER) AS wait FROM sessions")
def job_transitions(spark, sf):
    attempt = F.col("event_id") % 4 + 1
    state, wait = ops.after_attempt(attempt, F.col("seconds") % 2 == 0)
    return sessions(spark, sf).select("event_id", state.alias("state"), wait.alias("wait"))


@query(f"WITH {SESSIONS} SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM sessions WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 20 AND kind = 'view'")
def payload_filter(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return sessions(spark, sf).where((k < 20) & (F.col("kind") == "view")).select("event_id", k.alias("k"))


@query(f"WITH {SESSIONS}, r AS (SELECT user_id, event_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM sessions WHERE kind IN ('error', 'purchase')) SELECT user_id, event_id, kind FROM r WHERE k <= 10")
def recent_jobs(spark, sf):
    return best_per_key(sessions(spark, sf).where("kind IN ('error', 'purchase')"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "kind")


@query(f"WITH {SESSIONS}, n AS (SELECT user_id, kind, count(*) AS n, count(*) FILTER (WHERE seconds > 200) AS unread FROM sessions GROUP BY user_id, kind) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(unread) AS BIGINT) AS unread, max(CASE WHEN kind = 'error' THEN n ELSE 0 END) AS errors FROM n GROUP BY user_id")
def notification_counts(spark, sf):
    return sessions(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seconds") > 200).alias("unread"), F.count_if(F.col("kind") == "error").alias("errors"))


@query(f"WITH {SESSIONS}, a AS (SELECT event_id, seconds, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, sum(seconds) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM sessions WHERE seconds <= 1000) SELECT event_id FROM a WHERE k <= 12 AND total <= 3000")
def cache_eviction(spark, sf):
    """Too large entries go, then all but the newest twelve, then all beyond the total size."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = sessions(spark, sf).where("seconds <= 1000").withColumns({"k": F.row_number().over(w), "total": F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where("k <= 12 AND total <= 3000").select("event_id")
