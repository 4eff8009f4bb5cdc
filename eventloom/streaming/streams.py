"""Streaming twins of the daily steps; every query runs with availableNow as well as continuously."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.session import Scratch


def daily_counts(stream: DataFrame, ts: str = "ts", zone: str = "Asia/Taipei", late: str = "1 day") -> DataFrame:
    """Events a local day and type, with a watermark for late rows."""
    local = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return local.groupBy(F.to_date(F.from_utc_timestamp("_t", zone)).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def first_seen(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "30 days") -> DataFrame:
    """One row a key within the watermark."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def sessions(stream: DataFrame, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).groupBy(F.session_window("_t", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is, in batches; ``sink`` gets each batch and its number, and must be idempotent by it."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def collect_available(spark: SparkSession, df: DataFrame, label: str, mode: str) -> DataFrame:
    """A stream run to its end; each batch replaces its own folder, so a retried batch counts once."""
    scratch = Scratch(spark, label)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.base}/out/batch={number}")

    run_available(df, sink, f"{scratch.base}/checkpoint", mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{scratch.base}/out").select(*df.columns)


def write_day_stream(stream: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """Each batch's days are rewritten whole in the day store: what is there already is read with them."""

    def sink(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        days = [str(r["date"]) for r in batch.select("date").distinct().collect()]
        have = store.whole_days(days)
        merged = batch if have is None else batch.unionByName(have.select(*batch.columns))
        kept = Scratch(batch.sparkSession, "days").save(merged, "merged")
        store.write_days(kept, unique=True)

    return run_available(stream, sink, checkpoint)


_SEEN = "days array<int>, sources array<string>"
_WINDOWS = "entity string, day date, recent long, baseline long"
_EPOCH = datetime.date(1970, 1, 1)


def entity_windows(mentions: DataFrame, recent_days: int = 7, baseline_days: int = 30, late: str = "1 day") -> DataFrame:
    """(entity, day, recent, baseline) of a stream (entity, source, ts): each day's distinct sources of the last days and of the days before them.

    The state of an entity is its distinct (day, source); a row is met once. A batch gives the rows
    of the days that its new sources change, so the last row of an (entity, day) holds
    (``latest_available``). Days that no row before the watermark's end can reach leave the state,
    and an entity without days goes with a timer.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(zip(*state.get, strict=True)) if state.exists else set()
        fresh = {x for frame in frames for x in zip(frame["d"], frame["source"], strict=True)} - seen
        seen |= fresh
        by_day: dict[int, set[str]] = {}
        for day, source in seen:
            by_day.setdefault(day, set()).add(source)
        rows = []
        for last in sorted({day + k for day, _ in fresh for k in range(baseline_days)}):
            of = lambda first, end: len(set().union(*(by_day.get(last - k, ()) for k in range(first, end))))  # noqa: B023,E731
            rows.append((key[0], _EPOCH + datetime.timedelta(last), of(0, recent_days), of(recent_days, baseline_days)))
        # A row of the watermark's day can change a day's window whose first day is so far back.
        least = state.getCurrentWatermarkMs() // 86_400_000 - baseline_days + 1
        kept = sorted(x for x in seen if x[0] >= least)
        if kept:
            state.update(([d for d, _ in kept], [s for _, s in kept]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (kept[-1][0] + baseline_days) * 86_400_000))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["entity", "day", "recent", "baseline"])

    marked = mentions.withWatermark("ts", late).select("entity", F.coalesce("source", F.lit("")).alias("source"), "ts", F.unix_date(F.to_date("ts")).alias("d"))
    return marked.where(F.col("d").isNotNull()).groupBy("entity").applyInPandasWithState(run, _WINDOWS, _SEEN, "update", GroupStateTimeout.EventTimeTimeout)


def latest_available(spark: SparkSession, df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """A stream of updates run to its end: the last batch's row of each key."""
    scratch = Scratch(spark, label)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{scratch.base}/out/b={number}")

    run_available(df, sink, f"{scratch.base}/checkpoint", "update").awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])).parquet(f"{scratch.base}/out")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col("_batch")).alias("r"))
    return best.select("r.*")


def split_late(stream: DataFrame, root: str, ts: str = "ts", late_seconds: int = 86_400, trigger_checkpoint: str | None = None) -> StreamingQuery:
    """Write a stream's rows to ``root``/kept and those behind the watermark to ``root``/late, each batch to a folder of its own.

    The watermark of a batch is the latest time of all batches before it less ``late_seconds``; each
    batch leaves its latest time beside its rows, so that a batch that is run again, after a
    lost executor or driver, finds the same watermark and replaces its own folders. Rows without
    a time are kept.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = Scratch(spark, "late").save(batch, f"batch{number}")
        if number:
            marks = spark.read.schema("at timestamp, batch long").parquet(f"{root}/marks").where(F.col("batch") < number)
            before = marks.agg(F.max("at").alias("at")).first()["at"]
        else:
            before = None
        behind = F.lit(False) if before is None else F.coalesce(F.col(ts).cast("timestamp") < F.lit(before) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(late_seconds)), F.lit(False))
        for name, chosen in (("kept", ~behind), ("late", behind)):
            rows.where(chosen).write.mode("overwrite").parquet(f"{root}/{name}/b={number}")
        rows.agg(F.max(F.col(ts).cast("timestamp")).alias("at")).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/marks/b={number}")

    return run_available(stream, sink, trigger_checkpoint or f"{root}/checkpoint")
