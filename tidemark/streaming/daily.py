"""The incremental face: daily volumes behind a watermark, complete days, de-duplication of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators import dedup as P


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Events as they land in a folder; ``ts`` becomes a time that watermarks accept."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_volume(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """Count and value by day and family; a day is emitted once the watermark has passed it.

    Slots are counted approximately, as exact distinct aggregates do not stream.
    """
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    slot = F.floor(F.unix_timestamp("ts") / 900)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.approx_count_distinct(slot).alias("slots")).select(F.to_date("window.start").alias("day"), "event_type", "n", "v", "slots")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "6 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def complete_days(slices: DataFrame, per_day: int, time: str | None = None, late: str = "2 days") -> DataFrame:
    """(day, volume) of each day whose ``per_day`` slices have all come, in any order; slices: day, slot, n.

    State holds a day's slots seen and its sum; a repeated slice counts once. Of an
    emitted day a mark stays, so that slices that come again do not emit it again. With
    an event time ``time`` the mark goes once the watermark is ``late`` beyond it; without
    one it stays.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, total = state.get if state.exists else ([], 0)
        seen = set(seen)
        if -1 in seen:  # emitted before
            return
        for frame in frames:
            for slot, n in zip(frame["slot"], frame["n"], strict=True):
                if slot not in seen:
                    seen.add(int(slot))
                    total += int(n)
        if len(seen) < per_day:
            state.update((sorted(seen), total))
            return
        state.update(([-1], 0))
        if time:  # one more ``late`` beyond the watermark
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(pd.Timedelta(late).total_seconds() * 1000))
        yield pd.DataFrame({"day": [key[0]], "volume": [total / per_day]})

    kinds: dict[str, Any] = dict(slices.dtypes)
    timed = slices.withWatermark(time, late) if time else slices
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return timed.groupBy("day").applyInPandasWithState(step, f"day {kinds['day']}, volume double", "seen array<int>, total long", "append", timeout)


def first_copies(articles: DataFrame, within: str = "48 hours") -> DataFrame:
    """The first article of each normal title within the watermark's reach; exact titles only."""
    keyed = articles.withColumn("norm", X.normal_title(F.col("title"))).withWatermark("ts", within)
    return keyed.dropDuplicatesWithinWatermark(["norm"])


def near_copies(path: str, window_s: int = P.WINDOW_S, most: int = P.MOST_BITS):
    """A foreachBatch function that marks near copies of articles (id, t in seconds, title) among each batch and a tail of one window before it.

    Batches and their fingerprints are written under ``path``, a folder each, so that a
    repeated batch replaces itself. ``root`` is the earliest near copy, null for first ones.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("norm", X.normal_title(F.col("title"))).persist()
        named = rows.where("norm <> ''")
        P.simhash(named, "id", F.col("norm")).join(named.select("id", "t"), "id").write.mode("overwrite").parquet(f"{path}/prints/batch={number}")
        own = spark.read.parquet(f"{path}/prints/batch={number}").select("id", "t", "fp")
        start = own.agg(F.min("t")).first()[0]  # one number a batch
        tail = spark.read.parquet(f"{path}/prints").where((F.col("batch") < number) & (F.col("t") >= (start or 0) - window_s)).select("id", "t", "fp")
        pairs = P.near_pairs(own.union(tail), window_s, most).join(own.select("id"), "id", "left_semi")
        times = own.union(tail).select(F.col("id").alias("root"), F.col("t").alias("at"))
        first = pairs.join(times, "root").groupBy("id").agg(F.min(F.struct("at", "root"))["root"].alias("root"))
        rows.drop("norm").join(first, "id", "left").write.mode("overwrite").parquet(f"{path}/articles/batch={number}")
        rows.unpersist()

    return step


def run_once(df: DataFrame, path: str, mode: str = "append", step=None) -> DataFrame:
    """Drive a stream over what has landed and return its result, which executors write under ``path``; a later call goes on from there.

    ``step`` replaces the writer of batches; the result is then what it writes to ``path``/articles.
    """
    spark = df.sparkSession

    def written(batch: DataFrame, number: int) -> None:
        folder = f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    query = df.writeStream.outputMode(mode).foreachBatch(step or written).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(f"{path}/articles") if step else spark.read.schema(df.schema).parquet(f"{path}/rows")
