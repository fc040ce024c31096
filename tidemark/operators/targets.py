"""Targets and price features of a daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as N
from .calendar import by_date


def make_targets(panel: DataFrame, primary: str, returns: list[str] = (), levels: list[str] = (), band: float = 0.1, horizons: tuple[int, ...] = (3,), drop_zero: bool = False) -> DataFrame:
    """Labels of the primary series on the days it prints.

    Controls are carried forward over all dates before rows are cut to those days.
    ``returns`` become log returns, ``levels`` keep the level and its change. With
    ``drop_zero`` an unchanged price counts as no return. Horizon h sums the returns of
    the day and the next h - 1, with a band of sqrt(h) times the daily one.
    """
    others = [c for c in panel.columns if c not in ("date", primary)]
    filled = panel.select("date", primary, *[N.forward_fill(F.col(c), by_date()).alias(c) for c in others]).where(F.col(primary).isNotNull())
    y = N.log_return(F.col(primary), by_date())
    out = filled.withColumns(
        {"y_return": F.nullif(y, F.lit(0.0)) if drop_zero else y}
        | {f"ret_{c}": N.log_return(F.col(c), by_date()) for c in returns}
        | {f"chg_{c}": F.col(c) - F.lag(c).over(by_date()) for c in levels}
    )
    out = out.withColumns({"y_abs": F.abs("y_return"), "y_vol": N.trailing(F.stddev_samp, F.col("y_return"), by_date(), 5, include=True), "y_direction": N.direction(F.col("y_return"), band)})
    for h in horizons:
        out = out.withColumn(f"y_return_h{h}", N.horizon_sum(F.col("y_return"), by_date(), h))
        out = out.withColumn(f"y_direction_h{h}", N.direction(F.col(f"y_return_h{h}"), band * h**0.5))
    return out


def price_features(targets: DataFrame, ret: str = "y_return", lags: int = 5, windows: tuple[int, ...] = (5, 20), digits: int = 6) -> DataFrame:
    """What is known before the day: lagged returns, trailing mean and spread of past returns, the last move's size."""
    x = F.col(ret)
    out = {f"ret_lag{k}": F.lag(x, k).over(by_date()) for k in range(1, lags + 1)}
    for w in windows:
        out |= {f"mom{w}": N.trailing(F.avg, x, by_date(), w), f"vol{w}": N.trailing(F.stddev_samp, x, by_date(), w)}
    out["abs_last"] = F.abs(F.lag(x).over(by_date()))
    return targets.select("date", *[F.round(c, digits).alias(n) for n, c in out.items()])
