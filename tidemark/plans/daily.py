"""Whole plans over day-grain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import windows as N
from ..operators.aggregates import entropy


def direction_panel(bucketed: DataFrame, band: float = 0.1, window: int = 30, least: int = 3) -> DataFrame:
    """Daily article counts, their entropy over families and trailing score, a row behind the day's return and direction.

    The article table is aggregated once by (day, family); everything after that is day-grain.
    """
    counts = bucketed.groupBy("news_day", "theme_family").agg(F.count("*").alias("n"), F.sum("tone").alias("tones"), F.count("tone").alias("with_tone"))
    daily = counts.groupBy(F.col("news_day").alias("date")).agg(
        F.sum("n").alias("n"), entropy(F.col("n")).alias("entropy"), (F.sum("tones") / F.sum("with_tone")).alias("level")
    )
    by = W.orderBy("date")
    scored = daily.withColumns({"z": N.rolling_z(F.col("n"), by, window, least), "y": N.log_return(F.col("level"), by)})
    return scored.select(
        "date", F.lag("n").over(by).alias("n_articles"), F.round(F.lag("entropy").over(by), 6).alias("entropy"),
        F.round(F.lag("z").over(by), 6).alias("volume_z"), F.round("y", 4).alias("y_return"), N.direction(F.col("y"), band).alias("y_direction"),
    )
