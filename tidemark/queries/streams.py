"""Streams over the events folder, run once; batch SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..streaming import daily as Y
from .base import query, r6, scratch, table


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return Y.event_stream(spark, f"{d}/event[s].parquet", schema)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def stream_daily_volume(spark, d):
    """Daily counts over all that has landed."""
    t = Y.run_once(Y.daily_volume(_events(spark, d)), scratch(spark, "stream"), "complete")
    return t.select("day", "event_type", "n", r6("v", "v", 4))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, CAST(k AS BIGINT) AS k, count(*) AS n FROM s GROUP BY 1, 2""")
def stream_sessions(spark, d):
    """Sessions of a user with gaps under half an hour, numbered in time."""
    from pyspark.sql import Window as W

    t = Y.run_once(Y.sessions(_events(spark, d)), scratch(spark, "stream"), "complete")
    return t.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("start")).cast("long").alias("k"), "n")


@query("SELECT CAST(ts AS DATE) AS day, round(count(*) / 24.0, 6) AS volume FROM events GROUP BY 1 HAVING count(DISTINCT hour(ts)) = 24")
def stream_complete_days(spark, d):
    """Mean hourly volume of the days of which every hour has come."""
    hours = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("slot")).agg(F.count("*").cast("int").alias("n"), F.max(F.col("ts").cast("timestamp")).alias("ts"))
    path = scratch(spark, "hours")
    hours.write.parquet(path)
    stream = spark.readStream.schema(hours.schema).parquet(path)
    return Y.run_once(Y.complete_days(stream, 24, "ts"), scratch(spark, "stream")).select("day", r6("volume", "volume"))


@query()
def stream_near_copies(spark, d):
    """Titles of pages as they land, each with its earliest near copy within the window."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 3600).alias("t"), F.regexp_extract("html", X.PAGE_TITLE, 1).alias("title"))
    path = scratch(spark, "titles")
    pages.write.parquet(path)
    stream = spark.readStream.schema(pages.schema).parquet(path)
    out = scratch(spark, "stream")
    return Y.run_once(stream, out, step=Y.near_copies(out)).select("id", "root")
