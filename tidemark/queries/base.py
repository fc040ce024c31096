"""Registering queries, and the surrogate inputs that queries and their SQL share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Articles: one row an event, seen at ts, published locally seven hours later.
ART = """art AS (SELECT event_id AS article_id, ts AS seen_utc, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_date,
 event_type AS theme_family, 'C' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') AS country, user_id % 4 AS tier,
 1 + event_id % 4 AS dup_count, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS tone FROM events)"""
CAL = ART + ", cal AS (SELECT DISTINCT local_date AS td FROM art WHERE isodow(local_date) <= 5)"
BUCKET = CAL + ", bk AS (SELECT art.*, cal.td AS news_day FROM art ASOF LEFT JOIN cal ON art.local_date >= cal.td)"
#: A daily price: the dearest urgent order; controls print on other days too.
PX = """px AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price, count(*) AS n
 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"""
CTL = """ctl AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS level
 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"""
RET = PX + ", rt AS (SELECT *, 100 * (ln(price) - ln(lag(price) OVER (ORDER BY date))) AS ret FROM px)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.calendar import local_date

    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("article_id"), F.col("ts").alias("seen_utc"), local_date(F.col("ts"), "Asia/Jakarta").alias("local_date"),
        F.col("event_type").alias("theme_family"), F.concat(F.lit("C"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0")).alias("country"),
        (F.col("user_id") % 4).alias("tier"), (1 + F.col("event_id") % 4).alias("dup_count"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("tone"),
    )


def weekdays(arts: DataFrame) -> DataFrame:
    return arts.where(F.weekday("local_date") < 5).select(F.col("local_date").alias("td")).distinct()


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.calendar import floor_asof

    arts = articles(spark, sf_dir)
    return floor_asof(arts, "local_date", weekdays(arts)).withColumnRenamed("td", "news_day")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("price"), F.count("*").alias("n"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_totalprice").alias("level"))


def r6(column, name: str, digits: int = 6):
    """A double rounded as both sides round it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name)


def scratch(spark, name: str) -> str:
    """A folder of its own in the shared folder that the session names, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if base.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    return path
