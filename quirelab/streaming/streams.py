"""The time-series operators over event streams, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quirelab.session import discard, fresh_path, materialise, ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Events of a user's log that are kept. A fixed value.
LOG_SIZE = 1000
TERMINAL = ("succeeded", "failed")


def read_events(spark: SparkSession, folder: str, file: str = "events.parquet") -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", file).parquet(folder)
    seconds = F.floor(F.col("value") * 10).cast("long")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind"), seconds.alias("seconds"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, written to the shared folder and read back; complete results replace earlier ones."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, f"{name}-offsets"))
    folders: set[str] = set()

    def write(rows: DataFrame, batch: int) -> None:
        # A batch that is repeated after a failure writes over what it has left.
        folder = path if mode == "complete" else f"{path}/batch-{batch}"
        rows.write.mode("overwrite").parquet(folder)
        folders.add(folder)

    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*sorted(folders)) if folders else spark.createDataFrame([], stream.schema)


def run_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Everything that is there now, as run_once() gives it, through a step with state: of a batch's rows and the state before
    them (none at first) it gives results and the state after them.

    The state is a table in the shared folder, written anew by each batch. A batch that is repeated after a failure starts from
    the state that it found, which stays until the next batch is done."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    states: dict[int, DataFrame] = {}
    schema: list[StructType] = []

    def write(rows: DataFrame, batch: int) -> None:
        before = states.get(max((b for b in states if b < batch), default=-1))
        out, after = step(rows, before)
        out.write.mode("overwrite").parquet(f"{path}/batch-{batch}")
        states[batch] = materialise(after, f"{name}-state")
        schema[:] = [out.schema]
        for b in [b for b in states if b < batch - 1]:
            discard(states.pop(b))

    stream.writeStream.option("checkpointLocation", fresh_path(spark, f"{name}-offsets")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    for state in states.values():
        discard(state)
    if not schema:
        return spark.createDataFrame([], step(spark.createDataFrame([], stream.schema), None)[0].schema)
    return spark.read.schema(schema[0]).parquet(f"{path}/batch-*")


def weekly_seconds(events: DataFrame) -> DataFrame:
    """(week, seconds) in windows that begin on Mondays; the first Monday after the epoch is its fifth day."""
    sums = events.withWatermark("ts", "7 days").groupBy(F.window("ts", "7 days", startTime="4 days")).agg(F.sum("seconds").alias("seconds"))
    return sums.select(F.col("window.start").cast("date").alias("week"), "seconds")


def deduplicated(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """The first event of each key for as long as it is remembered."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def heartbeat_deltas(fresh: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(event_id, delta): how far a user's and kind's value rose above the last one; the state is that value of each key.

    A step for run_batches(): a key's state stands before its events, in windows that Spark computes without a call for each key."""
    rows = fresh.select("user_id", "kind", "event_id", "seconds", F.lit(True).alias("_fresh"))
    if state is not None:
        rows = rows.unionByName(state.withColumns({"event_id": F.lit(None).cast("long"), "_fresh": F.lit(False)}))
    w = Window.partitionBy("user_id", "kind").orderBy("_fresh", "event_id")
    rose = rows.withColumn("delta", F.greatest(F.lit(0).cast("long"), F.col("seconds") - F.coalesce(F.lag("seconds").over(w), F.lit(0))))
    return rose.where("_fresh").select("event_id", "delta"), rows.groupBy("user_id", "kind").agg(F.max_by("seconds", F.struct("_fresh", "event_id")).alias("seconds"))


def rate_limited(fresh: DataFrame, state: DataFrame | None, seconds: int, limit: int, delay: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(event_id, allowed): whether an event is among the first of its user in a fixed window; the state is a count for each
    user and window, dropped `delay` seconds after the newest event has passed the window's end. Events that are as late are
    dropped.

    A step for run_batches(), like heartbeat_deltas(). The newest event's window is never dropped, so the state holds its time."""
    key = ["user_id", "window"]
    rows = fresh.select("user_id", F.floor(F.unix_timestamp("ts") / seconds).alias("window"), "ts", "event_id", F.lit(1).cast("long").alias("n"), F.lit(True).alias("_fresh"))
    if state is not None:
        over = F.unix_micros("ts") <= (_newest(state) - delay) * 1_000_000
        rows = rows.where(~F.coalesce(over, F.lit(False))).unionByName(state.withColumns({"event_id": F.lit(None).cast("long"), "_fresh": F.lit(False)}))
    w = Window.partitionBy(*key).orderBy("_fresh", F.col("ts").asc_nulls_last(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("allowed", F.sum("n").over(w) <= limit)
    left = rows.groupBy(*key).agg(F.max("ts").alias("ts"), F.sum("n").alias("n"))
    kept = F.col("window").isNull() | ((F.col("window") + 1) * seconds > _newest(rows) - delay)
    return counted.where("_fresh").select("event_id", "allowed"), left.where(kept)


def _newest(rows: DataFrame) -> int:
    """Seconds of the newest ts, the epoch without one."""
    return rows.agg(F.unix_timestamp(F.max("ts")).alias("at")).first()["at"] or 0


def capped_log(log: DataFrame, fresh: DataFrame, size: int = LOG_SIZE) -> DataFrame:
    """A user's log with new events appended, of which the newest `size` stay (for use in foreachBatch)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return log.unionByName(fresh).dropDuplicates(["event_id"]).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")


def replayed(log: DataFrame, user_id: int, last_event_id: int) -> DataFrame:
    """What a reader gets that has seen the log up to an event: strictly later ones, in order."""
    return log.where((F.col("user_id") == user_id) & (F.col("event_id") > last_event_id)).orderBy("event_id")


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, event_id, state): a job's events up to the first terminal state; later ones are dropped."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for i, s in zip(rows["event_id"].tolist(), rows["state"].tolist()):
            if over:
                break
            out.append((key[0], i, s))
            over = s in TERMINAL
        state.update((over,))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "state"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, event_id long, state string", "over boolean", "append", GroupStateTimeout.NoTimeout)
