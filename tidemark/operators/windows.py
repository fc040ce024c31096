"""Trailing, forward and exponentially weighted statistics over ordered rows; ROWS frames, nulls as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def guarded(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """``value`` where the frame has at least ``least`` values of ``x``."""
    return F.when(F.count(x).over(frame) >= least, value)


def rolling_z(x: Column, order: WindowSpec, window: int = 30, least: int = 10) -> Column:
    """Standard score of a row against the ``window`` rows before it, itself left out; no spread gives null."""
    frame = order.rowsBetween(-window, -1)
    z = (x - F.avg(x).over(frame)) / F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0))
    return guarded(z, x, frame, least)


def trailing(f, x: Column, order: WindowSpec, window: int, include: bool = False, least: int | None = None) -> Column:
    """An aggregate of the last ``window`` rows, the row itself with ``include``; a full window by default."""
    frame = order.rowsBetween(1 - window, 0) if include else order.rowsBetween(-window, -1)
    return guarded(f(x).over(frame), x, frame, least or window)


def horizon_sum(x: Column, order: WindowSpec, rows: int) -> Column:
    """Sum of this and the next rows - 1 values, all of them there."""
    frame = order.rowsBetween(0, rows - 1)
    return guarded(F.sum(x).over(frame), x, frame, rows)


def log_return(price: Column, order: WindowSpec) -> Column:
    return 100 * (F.ln(price) - F.ln(F.lag(price).over(order)))


def forward_fill(x: Column, order: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))


#: Half-lives of one block of :func:`ewm_mean`: what lies two blocks back weighs less than a double can tell.
BLOCK_HALFLIVES = 200


def ewm_mean(df: DataFrame, x: Column, name: str, order: str, halflife: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: the exponentially weighted mean so far of ``x`` that skips nulls, in groups ``by``.

    Weights grow as 2 ** (i / halflife) with i the number of values so far, counted from
    the start of a block; the sums of the block before are carried in, scaled down. So
    weights stay finite, however long the series.
    """
    size = F.lit(float(BLOCK_HALFLIVES * halflife))
    i = F.count("_x").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    own = df.withColumn("_x", x.cast("double")).withColumn("_i", i).withColumn("_b", F.floor(F.col("_i") / size))
    own = own.withColumn("_w", F.when(F.col("_x").isNotNull(), F.pow(F.lit(2.0), (F.col("_i") - F.col("_b") * size) / halflife)))
    sums = {"s": F.sum(F.col("_x") * F.col("_w")), "w": F.sum("_w")}
    so_far = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    blocks = own.groupBy(*by, "_b").agg(*[F.coalesce(c, F.lit(0.0)).alias(f"_p{n}") for n, c in sums.items()]).withColumn("_b", F.col("_b") + 1)
    joined = own.withColumns({f"_{n}": c.over(so_far) for n, c in sums.items()}).join(blocks, [*by, "_b"], "left")
    total = {n: F.coalesce(f"_{n}", F.lit(0.0)) + F.coalesce(F.col(f"_p{n}"), F.lit(0.0)) * 2.0**-BLOCK_HALFLIVES for n in sums}
    return joined.select(*df.columns, F.try_divide(total["s"], total["w"]).alias(name))


def softmax(score: Column, group: WindowSpec) -> Column:
    e = F.exp(score - F.max(score).over(group))
    return e / F.sum(e).over(group)


def islands(df: DataFrame, flag: str, order: str = "date", least: int = 3) -> DataFrame:
    """Runs of rows where ``flag`` holds: first and last date and length in calendar days, of at least ``least``."""
    by = W.orderBy(order)
    marked = df.withColumn("_fresh", F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(by), F.lit(False)), 1).otherwise(0)).withColumn("_island", F.sum("_fresh").over(by))
    runs = marked.where(flag).groupBy("_island").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    return runs.withColumn("length", F.datediff("end", "start") + 1).where(F.col("length") >= least).drop("_island")


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in a total order; Spark limits groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def chronological_split(date: Column, train_end: str, val_end: str) -> Column:
    day = lambda s: F.lit(s).cast("date")
    return F.when(date <= day(train_end), "train").when(date <= day(val_end), "val").otherwise("test")


def direction(x: Column, band: float) -> Column:
    """UP above the band, DOWN below its negative, FLAT between; null stays null."""
    return F.when(x.isNull(), None).when(x > band, "UP").when(x < -band, "DOWN").otherwise("FLAT")


def average_rank(x: str, group: list[str] | None = None) -> Column:
    """Rank with ties given their mean rank."""
    by = W.partitionBy(*(group or [])).orderBy(x)
    return F.rank().over(by) + (F.count("*").over(W.partitionBy(*(group or []), x)) - 1) / 2.0
