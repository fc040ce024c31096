"""Aggregates over groups: concentration, weighted means, shares, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entropy(n: Column) -> Column:
    """Shannon entropy (nats) of counts in a group: ln N - sum(n ln n) / N; null without counts."""
    total = F.sum(n)
    return F.when(total > 0, F.ln(total) - F.sum(F.when(n > 0, n * F.ln(n)).otherwise(0.0)) / total)


def herfindahl(n: Column) -> Column:
    """Sum of squared shares of counts in a group."""
    return F.try_divide(F.sum(n * n), F.sum(n) * F.sum(n))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight; null values and their weights are left out."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def weighted_ratio(numerator: Column, denominator: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * numerator), F.sum(weight * denominator))


def syndication_weight(dup_count: Column, damped: bool = True) -> Column:
    """log(1 + copies), so that a story of many copies counts more, but not in proportion."""
    return F.log1p(F.greatest(dup_count, F.lit(1)).cast("double")) if damped else F.lit(1.0)


def share(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def shares_wide(df: DataFrame, key: str, category: str, values: list, prefix: str = "share_") -> DataFrame:
    """Share of each category in a key's rows, 0 where absent; one aggregation, no pivot shuffle."""
    return df.groupBy(key).agg(*[F.avg((F.coalesce(F.col(category).eqNullSafe(v), F.lit(False))).cast("int")).alias(f"{prefix}{v}") for v in values])


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value most rows of a key have; of equals the first in order. Nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("_r", best).where("_r = 1").select(key, value, "n")


def timeline_wide(df: DataFrame, families: list[str], metric: str, value: str) -> DataFrame:
    """Mean of ``value`` by date, a column a family."""
    return df.groupBy("date").pivot("theme_family", families).agg(F.avg(value)).select("date", *[F.col(f"`{f}`").alias(f"gdelt_{metric}_{f}") for f in families])


def unpivot(row: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Columns of a one-row table as rows of (name, double)."""
    return row.select([F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, key, value)


def adjusted_skewness(x: Column) -> Column:
    """Sample skewness, adjusted as spreadsheets do."""
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(x: Column) -> Column:
    """Sample excess kurtosis, adjusted as spreadsheets do."""
    n = F.count(x)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of pairs without nulls; null where either is constant, which ``corr`` refuses."""
    x, y = x.cast("double"), y.cast("double")
    own, other = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(own, other), F.stddev_pop(own) * F.stddev_pop(other))
