"""Seeded synthetic inputs with planted shocks: prices, articles and timelines for checks without a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("conflict", "energy", "trade")
HEADLINES = {
    "conflict": "Troops clash near the border as talks stall in sector {}",
    "energy": "Oil price climbs after OPEC cuts output by {} percent",
    "trade": "New tariff on goods from China hits {} importers",
}


def _unit(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1) of its arguments: the same on any cluster."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003.0


def _normal(*parts: Column) -> Column:
    u, v = _unit(*parts, F.lit("u")), _unit(*parts, F.lit("v"))
    return F.sqrt(-2 * F.ln(u + 1e-7)) * F.cos(2 * 3.141592653589793 * v)


def shocks(days: DataFrame, seed: int, share: float = 0.08) -> DataFrame:
    """Days (date) with 0 or 1 in ``shock``."""
    return days.withColumn("shock", (_unit(F.lit(seed), F.col("date").cast("string"), F.lit("shock")) < share).cast("int"))


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return d.where(F.weekday("date") < 5)


def fx_panel(days: DataFrame, seed: int = 42) -> DataFrame:
    """USD_IDR and DXY on weekdays: the target moves the day *after* a shock."""
    from pyspark.sql import Window as W

    by = W.orderBy("date")
    s = shocks(days, seed).withColumn("before", F.coalesce(F.lag("shock").over(by), F.lit(0)))
    step = 0.0015 * _normal(F.lit(seed), F.col("date").cast("string")) + 0.02 * F.col("before")
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    dxy = 0.002 * _normal(F.lit(seed + 1), F.col("date").cast("string"))
    return s.select("date", (15000 * F.exp(F.sum(step).over(so_far))).alias("USD_IDR"), (100 * F.exp(F.sum(dxy).over(so_far))).alias("DXY"))


def articles(days: DataFrame, seed: int = 42, usual: int = 12, extra: int = 40) -> DataFrame:
    """Articles of each day, many more on a shock; about a sixth is republished by another outlet two hours later."""
    per_day = shocks(days, seed).withColumn("n", usual + extra * F.col("shock"))
    a = per_day.select("date", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    date, i = F.col("date").cast("string"), F.col("i")
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.pmod(F.xxhash64(date, i), F.lit(len(FAMILIES))) + 1).cast("int"))
    a = a.withColumns({"theme_family": family, "code": F.pmod(F.xxhash64(date, i, F.lit(seed)), F.lit(100_000)).cast("string")})
    title = F.lit(None).cast("string")
    for f in FAMILIES:
        title = F.when(F.col("theme_family") == f, F.concat(F.lit(HEADLINES[f].split("{}")[0]), F.col("code"), F.lit(HEADLINES[f].split("{}")[1]))).otherwise(title)
    seen = F.timestamp_add("MINUTE", (60 + 10 * (i % 60)).cast("int"), F.col("date").cast("timestamp_ntz"))
    base = a.select("theme_family", title.alias("title"), seen.alias("seen"), F.concat(F.lit("https://a.com/"), date, F.lit("/"), F.col("code"), F.lit("/"), i).alias("url"), F.lit("reuters.com").alias("domain"), F.lit("US").alias("sourcecountry"))
    again = base.where(F.pmod(F.xxhash64("url"), F.lit(6)) == 0).withColumns({"url": F.replace("url", F.lit("a.com"), F.lit("b.com")), "domain": F.lit("b.com"), "seen": F.timestamp_add("HOUR", F.lit(2), F.col("seen"))})
    return base.union(again).withColumn("article_id", F.md5("url"))


def timelines(days: DataFrame, seed: int = 42) -> DataFrame:
    """Tidy rows (date, value, theme_family, metric) of volumes that rise on shocks."""
    s = shocks(days, seed).withColumn("theme_family", F.explode(F.array(*[F.lit(f) for f in FAMILIES])))
    value = 1 + 3 * F.col("shock") + 0.1 * _normal(F.col("date").cast("string"), F.col("theme_family"))
    return s.select("date", value.alias("value"), "theme_family", F.lit("volume").alias("metric"))
