"""Reports on data quality and leakage; every report is one or two aggregations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import aggregates as A
from .calendar import by_date


def coverage_by_year(days: DataFrame, daily: DataFrame) -> DataFrame:
    """Trading days, those with articles, their share in percent and the median count, by year."""
    joined = days.join(daily, "date", "left")
    return joined.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("trading_days"), F.count("n_articles").alias("days_with_news"), (100 * F.count("n_articles") / F.count("*")).alias("pct"), F.median(F.coalesce("n_articles", F.lit(0))).alias("median_articles")
    )


def cap_saturation(df: DataFrame, day: str, family: str, cap: int = 250) -> DataFrame:
    """How often a family's day reaches the cap, and the median and largest day."""
    n = df.groupBy(day, family).agg(F.count("*").alias("n"))
    return n.groupBy(family).agg((100 * A.share(F.col("n") >= cap)).alias("pct_at_cap"), F.median("n").alias("median"), F.max("n").alias("max"))


def structural_break(df: DataFrame, value: str) -> DataFrame:
    y = df.groupBy(F.year("date").alias("year")).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return y.withColumn("yoy", F.try_divide("median", F.lag("median").over(W.orderBy("year"))))


def target_stats(df: DataFrame, ret: str, band: float) -> DataFrame:
    """Moments, sample-adjusted shape, extremes, lag-1 correlation and class shares as (metric, value)."""
    x = F.col(ret)
    lagged = df.withColumn("_p", F.lag(ret).over(by_date()))
    return A.unpivot(
        lagged.agg(
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), A.adjusted_skewness(x).alias("skew"), A.adjusted_kurtosis(x).alias("kurtosis"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.corr(x, F.col("_p")).alias("autocorr1"), A.share(x > band).alias("up"), A.share(x < -band).alias("down"),
        )
    )


def sanity_checks(df: DataFrame, ret: str, deviations: float = 5, large: float = 3) -> DataFrame:
    """Exact zeros, returns beyond some deviations and large moves, with a verdict each."""
    moments = df.agg(F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"))
    joined = df.select(ret).crossJoin(F.broadcast(moments))  # one row of moments
    x = F.col(ret)
    counts = joined.agg(F.count_if(x == 0).alias("zero"), F.count_if(F.abs(x - F.col("m")) > deviations * F.col("sd")).alias("far"), F.count_if(F.abs(x) > large).alias("large"))
    named = (("exact zero returns", "zero"), (f"beyond {deviations} deviations", "far"), ("large moves", "large"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("check"), F.col(c).alias("n"), F.when(F.col(c) == 0, "PASS").otherwise("REVIEW").alias("verdict")) for t, c in named])))


def rules(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Aggregate conditions as (rule, ok), all of them in one pass."""
    out = df.agg(*[c.alias(f"r{i}") for i, c in enumerate(checks.values())])
    return out.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("ok")) for i, n in enumerate(checks)])))


def missingness(df: DataFrame, top: int) -> DataFrame:
    """Columns with the largest share of nulls."""
    out = A.unpivot(df.agg(*[A.share(F.col(c).isNull()).alias(c) for c in df.columns]), "column", "missing")
    return out.orderBy(F.desc("missing"), "column").limit(top)


def feature_dictionary(df: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Columns with group (the first prefix that fits), values, mean and spread."""
    stats = df.agg(*[F.struct(F.count(c).alias("non_null"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in df.columns])
    rows = stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.non_null"), F.col(f"`{c}`.mean"), F.col(f"`{c}`.std")) for c in df.columns])))
    group = F.lit("other")
    for prefix, name in reversed(prefixes):
        group = F.when(F.col("column").startswith(prefix), name).otherwise(group)
    return rows.withColumn("group", group)


def entity_block(df: DataFrame, day: str, groups: Mapping[str, Column], tone: str = "tone", dup: str = "dup_count") -> DataFrame:
    """Weighted share (0 where absent) and tone (null where absent) of each group of articles by day."""
    w = A.syndication_weight(F.col(dup))
    columns = []
    for name, own in groups.items():
        columns += [(F.coalesce(F.sum(F.when(own, w)), F.lit(0.0)) / F.sum(w)).alias(f"share_{name}"), A.weighted_mean(F.when(own, F.col(tone)), w).alias(f"tone_{name}")]
    return df.groupBy(day).agg(*columns)


def leakage(frame: DataFrame, target: str, lag: str = "feature_lag_days", split: str = "split", limit: float = 0.95) -> DataFrame:
    """Problems of a modelling frame as (problem, detail), none if it is clean.

    Lags below one row, repeated dates, splits that overlap in time, and numeric columns
    whose correlation with the target is beyond the limit (pairs without nulls; constant
    columns have none).
    """
    numeric = [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint") and c not in (target, lag)]
    one = frame.agg(
        F.min(lag).alias("lag"), (F.count("*") - F.count_distinct("date")).alias("repeated"), *[A.correlation(F.col(c), F.col(target)).alias(f"_{c}") for c in numeric]
    )
    found = [
        F.when(F.col("lag") < 1, F.struct(F.lit("lag below one row").alias("problem"), F.col("lag").cast("string").alias("detail"))),
        F.when(F.col("repeated") > 0, F.struct(F.lit("repeated dates").alias("problem"), F.col("repeated").cast("string").alias("detail"))),
        *[F.when(F.abs(F.col(f"_{c}")) > limit, F.struct(F.lit("correlates with the target").alias("problem"), F.lit(c).alias("detail"))) for c in numeric],
    ]
    out = one.select(F.inline(F.array_compact(F.array(*found))))
    spans = frame.groupBy(split).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    before = F.max("last").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    overlap = spans.withColumn("_before", before).where(F.col("first") <= F.col("_before"))
    return out.union(overlap.select(F.lit("splits overlap"), F.col(split)))
