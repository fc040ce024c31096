"""Trading calendars, floor as-of alignment and the joins that keep features behind their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    """Order of a day-grain table, which has thousands of rows at any number of articles."""
    return W.orderBy("date")


def local_date(ts: Column, zone: str) -> Column:
    """Calendar date in ``zone`` of a UTC time: converted first, then cut to a date."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")))


def trading_calendar(panel: DataFrame, primary: str | None = None) -> DataFrame:
    """Dates on which the primary series prints; without one, on which any column does."""
    values = [primary] if primary else [c for c in panel.columns if c != "date"]
    printed = F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull()
    return panel.where(printed).select(F.col("date").alias("td")).distinct()


def buckets(calendar: DataFrame, last_hours: int = 24, long_hours: int = 30) -> DataFrame:
    """Add to each trading day the hours to the next (``last_hours`` for the last) and whether they exceed ``long_hours``."""
    following = F.lead("td").over(W.orderBy("td"))
    hours = F.coalesce(F.datediff(following, F.col("td")) * 24, F.lit(last_hours)).cast("double")
    return calendar.withColumn("window_hours", hours).withColumn("is_post_weekend", F.col("window_hours") > long_hours)


def floor_asof(df: DataFrame, date: str, calendar: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``td``, the last trading day on or before ``date``; null before the first.

    The calendar becomes a dense table date -> trading day, so that a plain equi-join
    on the date does; it is broadcast, as it has a row a calendar day, whatever the
    number of articles.
    """
    following = F.lead("td").over(W.orderBy("td"))
    until = F.coalesce(F.date_sub(following, 1), F.col("td"))
    dense = calendar.withColumn("_until", until).select("td", *keep, F.explode(F.sequence("td", "_until")).alias("_day"))
    last = calendar.agg(F.max(F.struct("td", *keep)).alias("_last"))
    joined = df.join(F.broadcast(dense), df[date] == dense["_day"], "left").crossJoin(F.broadcast(last))  # one row
    beyond = F.col("_day").isNull() & (df[date] > F.col("_last.td"))
    return joined.withColumns({c: F.when(beyond, F.col(f"_last.{c}")).otherwise(F.col(c)) for c in ("td", *keep)}).drop("_day", "_last")


def attach_news_day(articles: DataFrame, calendar: DataFrame, date: str = "local_date") -> DataFrame:
    """Give every article its bucket: news_day, window_hours, is_post_weekend; rows before the first day go."""
    out = floor_asof(articles, date, buckets(calendar), ("window_hours", "is_post_weekend"))
    return out.where("td IS NOT NULL").withColumnRenamed("td", "news_day")


def lag_rows(daily: DataFrame, columns: list[str], rows: int = 1, prefix: str = "") -> DataFrame:
    """Columns shifted down by ``rows`` rows of the daily table."""
    return daily.select("date", *[F.lag(c, rows).over(by_date()).alias(prefix + c) for c in columns])


def reindex(daily: DataFrame, calendar: DataFrame, zero: list[str]) -> DataFrame:
    """One row a trading day: counts absent become 0, other columns stay null."""
    days = calendar.select(F.col("td").alias("date"))
    out = days.join(daily, "date", "left")
    return out.select("date", *[F.coalesce(c, F.lit(0)).alias(c) if c in zero else F.col(c) for c in daily.columns if c != "date"])


def prediction_frame(features: DataFrame, market: DataFrame, labels: DataFrame, lag: int = 1) -> DataFrame:
    """Features and market columns of ``lag`` rows before, joined to labels of the day; says so in feature_lag_days."""
    f = lag_rows(features, [c for c in features.columns if c != "date"], lag)
    m = lag_rows(market, [c for c in market.columns if c != "date"], lag, f"lag{lag}_")
    return f.join(m, "date", "full").join(labels, "date").withColumn("feature_lag_days", F.lit(lag))


def lag_to_rows(daily: DataFrame, columns: list[str], calendar: DataFrame, rows: DataFrame, lag: int = 1) -> DataFrame:
    """Right-align to the calendar, shift, and keep the dates of ``rows``."""
    aligned = calendar.select(F.col("td").alias("date")).join(daily.select("date", *columns), "date", "left")
    return lag_rows(aligned, columns, lag).join(rows.select("date"), "date", "left_semi")


def outer_panel(series: dict[str, DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """Full outer alignment of (date, value) series on date, clipped to a period with both ends."""
    if not series:
        raise ValueError("no series to align")
    out = None
    for name, s in series.items():
        s = s.select("date", F.col("value").alias(name))
        out = s if out is None else out.join(s, "date", "full")
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out
