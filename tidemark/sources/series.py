"""Daily series: sheets with a header found by content, chart payloads, panels, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D

CHART_JSON = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"


def parse_sheet(cells: DataFrame, date_title: str = "tanggal", rate_title: str = "kurs", stamp: str = "M/d/yyyy h:mm:ss a") -> DataFrame:
    """(date, value) of a sheet whose header is somewhere; ``cells``: row_no, cells (array of text).

    The header is the first row that holds the date title; columns are where the titles
    stand. Bad dates and values go; of a date's rows the last stays.
    """
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    head = cells.where(F.array_contains(low, date_title)).orderBy("row_no").limit(1)
    at = head.select(F.col("row_no").alias("h"), (F.array_position(low, date_title)).cast("int").alias("d"), (F.array_position(low, rate_title)).cast("int").alias("r"))
    body = cells.crossJoin(F.broadcast(at)).where("row_no > h")  # one header row
    parsed = body.select("row_no", F.to_date(F.try_to_timestamp(F.try_element_at("cells", F.col("d")), F.lit(stamp))).alias("date"), F.try_element_at("cells", F.col("r")).try_cast("double").alias("value"))
    last = F.row_number().over(W.partitionBy("date").orderBy(F.desc("row_no")))
    return parsed.dropna(subset=["date", "value"]).withColumn("_r", last).where("_r = 1").select("date", "value")


def parse_chart(payloads: DataFrame, zone: str = "Asia/Jakarta", column: str = "payload") -> DataFrame:
    """(ticker, date, value): last close of each local date of landed chart payloads, of equal times the later in its payload; nulls go."""
    r = F.from_json(column, CHART_JSON)["chart"]["result"][0]
    points = payloads.select("ticker", F.posexplode(F.arrays_zip(r["timestamp"].alias("ts"), r["indicators"]["quote"][0]["close"].alias("close"))).alias("at", "point"))
    dated = points.select("ticker", "at", "point.ts", "point.close").where("close IS NOT NULL").withColumn("date", D.epoch_local_date(F.col("ts"), zone))
    return dated.groupBy("ticker", "date").agg(F.max(F.struct("ts", "at", "close"))["close"].alias("value"))


def read_splits(spark, paths: dict[str, str], schema: str) -> DataFrame:
    """Train, validation and test files as one table with ``split``."""
    out = None
    for split, path in paths.items():
        own = spark.read.schema(schema).csv(path, header=True).withColumn("split", F.lit(split))
        out = own if out is None else out.unionByName(own)
    return out


def write_splits(df: DataFrame, path: str) -> None:
    """One folder a split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> bool:
    """A report as one CSV file; an empty one is not written."""
    if df.isEmpty():
        return False
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return True


def manifest(df: DataFrame, **counts: Column) -> str:
    """Aggregates of a table as one JSON text."""
    return json.dumps(df.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict(), default=str, sort_keys=True)


def write_dataset(df: DataFrame, path: str, **counts: Column) -> None:
    """A table as Parquet, and beside it the manifest of what it holds; Spark's commit shows a finished table or none."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    text = manifest(spark.read.parquet(f"{path}/data"), **counts)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_dataset(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def read_manifest(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def write_sample(df: DataFrame, strata: list[str], size: int, seed: int, key: str, path: str, built: dict, rows: int) -> int:
    """A stratified sample of a build as one CSV file; returns its rows. A synthetic or stale build, whose manifest has another count, is refused."""
    from ..operators.sampling import stratified

    if built.get("synthetic"):
        raise ValueError("samples are not drawn from a synthetic build")
    if built.get("rows") != rows:
        raise ValueError(f"the manifest has {built.get('rows')} rows and the table {rows}: the build is stale")
    own = stratified(df, strata, size, seed, key)
    write_report(own, path)
    return own.count()


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that no finished part covers."""
    return work.join(done.select(key), key, "left_anti")


def assemble(work: DataFrame, parts: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """All work with the parts' results; what no part has gets a zero vector and nulls."""
    out = work.join(parts, key, "left")
    return out.withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), width)))
