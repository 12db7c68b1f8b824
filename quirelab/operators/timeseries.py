"""Weekly buckets, quotas, heartbeats, rate limits, review states, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until the next review by stage, job retry delays in seconds and attempts, monthly limits.
REVIEW_DAYS = (1, 3, 7, 14, 30)
BACKOFF, ATTEMPTS = (30, 120, 480), 4
MONTHLY_LIMITS = {"click": 30, "view": 500, "purchase": 20, "signup": 30, "error": 300}
#: Progress that a job's stage stands for.
STAGE_PROGRESS = {"fetching": 5, "parsing": 20, "structuring": 35, "abstract": 50, "readable": 65, "body": 80, "complete": 100}
READING_SECONDS, REACHED_END = 180, 0.90


def stage_progress(stage: Column) -> Column:
    """Per cent that a stage stands for, null for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in STAGE_PROGRESS.items() for x in pair])
    return F.try_element_at(known, stage)


def weekly_hours(sessions: DataFrame, end: str, weeks: int = 12) -> DataFrame:
    """(week, hours): the weeks up to the one that holds `end`, oldest first, 0 where nothing was read; Mondays, UTC.

    Hours are rounded half to even at one decimal."""
    spark = sessions.sparkSession
    last = F.date_trunc("week", F.lit(end).cast("timestamp")).cast("date")
    frame = spark.range(weeks).select(F.date_sub(last, (F.lit(weeks - 1) - F.col("id")).cast("int") * 7).alias("week"))
    sums = sessions.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.sum("seconds").alias("s"))
    return frame.join(sums, "week", "left").select("week", F.bround(F.coalesce("s", F.lit(0)) / 3600, 1).alias("hours"))


def month_in(zone: str, ts: Column) -> Column:
    """The first day of the month of a UTC time, as it is in a time zone."""
    return F.date_trunc("month", F.from_utc_timestamp(ts, zone)).cast("date")


def heartbeats(beats: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """delta: how far a cumulative value rose above the one before it, never below 0; the first counts whole."""
    w = Window.partitionBy(*keys).orderBy(order)
    return beats.withColumn("delta", F.greatest(F.lit(0).cast("long"), F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))))


def rate_limited(requests: DataFrame, key: str, ts: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """allowed: whether a request is among the first `limit` of its key in a fixed window."""
    window = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds).alias("window")
    rows = requests.withColumn("window", window)
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(key, "window").orderBy(ts, tie)) <= limit)


def ttl_deduplicated(rows: DataFrame, keys: list[str], ts: str, days: int, tie: str | None = None) -> DataFrame:
    """Of each key the first row, and then each first row that is `days` or more after the last one kept; ties by `tie`.

    A key's rows are sorted in one task and walked batch by batch; only the last key and its last kept time are held."""
    step = days * 86_400_000_000
    # null keys are keys; rows without a time are not kept.
    marked = rows.where(F.col(ts).isNotNull()).withColumns({"_key": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    ordered = marked.repartition("_key").sortWithinPartitions("_key", "_us", *([tie] if tie else []))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, 0
        for batch in batches:
            keep = []
            for key, us in zip(batch.column("_key").to_pylist(), batch.column("_us").to_pylist()):
                keep.append(key != last or us >= until)
                if keep[-1]:
                    last, until = key, us + step
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(walk, ordered.schema).drop("_key", "_us")


def review(stage: Column, mastered: Column, good: Column) -> tuple[Column, Column]:
    """Stage and mastered after a review: again goes back to 1, good goes on, and is mastered from the last stage."""
    last = len(REVIEW_DAYS)
    done = good & (mastered | (stage >= last))
    return F.when(~good, 1).when(done, last).otherwise(stage + 1), done


def replay_reviews(results: Column) -> Column:
    """Of an array of booleans (good or not) in order: struct(stage, mastered, n)."""
    start = F.struct(F.lit(1).alias("stage"), F.lit(False).alias("mastered"), F.lit(0).alias("n"))

    def step(s: Column, good: Column) -> Column:
        stage, mastered = review(s["stage"], s["mastered"], good)
        return F.struct(stage.cast("int").alias("stage"), mastered.alias("mastered"), (s["n"] + 1).cast("int").alias("n"))

    return F.aggregate(results, start, step)


def next_review(day: Column, stage: Column, mastered: Column) -> Column:
    return F.when(~mastered, F.date_add(day, F.element_at(F.array(*map(F.lit, REVIEW_DAYS)), stage)))


def suggested_status(status: Column, seconds: Column, reached_end: Column) -> Column:
    return F.when(status.isin("planned", "up_next") & (seconds >= READING_SECONDS), "reading").when((status == "reading") & reached_end, "done")


def after_attempt(attempt: Column, ok: Column) -> tuple[Column, Column]:
    """A job's state after its attempt (from 1), and the seconds until it is tried again."""
    state = F.when(ok, "succeeded").when(attempt >= ATTEMPTS, "failed").otherwise("queued")
    return state, F.when(state == "queued", F.element_at(F.array(*map(F.lit, BACKOFF)), attempt.cast("int")))
