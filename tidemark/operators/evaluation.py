"""Model comparison: classification and regression metrics, paired resampling, rank statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows as N

CLASSES = ("DOWN", "FLAT", "UP")


def f1(true: Column, pred: Column, label: str) -> Column:
    """F1 of one class; 0 where it neither occurs nor is predicted."""
    hit = F.count_if((true == label) & (pred == label))
    return F.coalesce(F.try_divide(2 * hit, F.count_if(true == label) + F.count_if(pred == label)), F.lit(0.0))


def macro_f1(true: Column, pred: Column) -> Column:
    return sum((f1(true, pred, c) for c in CLASSES[1:]), f1(true, pred, CLASSES[0])) / 3


def classification(true: Column, pred: Column) -> dict[str, Column]:
    """Macro F1 over the three classes, accuracy, hit rate where a move is predicted, coverage, F1 by class."""
    moves = pred != "FLAT"
    own = {"macro_f1": macro_f1(true, pred), "accuracy": F.avg((true == pred).cast("int")), "hit_rate": F.try_divide(F.count_if(moves & (true == pred)), F.count_if(moves)), "coverage": F.avg(moves.cast("int"))}
    return own | {f"f1_{c}": f1(true, pred, c) for c in CLASSES}


def regression(true: Column, pred: Column) -> dict[str, Column]:
    """RMSE, MAE, sign agreement where the truth moves, and R2 against forecasting zero."""
    return {
        "rmse": F.sqrt(F.avg((true - pred) * (true - pred))), "mae": F.avg(F.abs(true - pred)),
        "directional": F.try_divide(F.count_if((true != 0) & (F.signum(true) == F.signum(pred))), F.count_if(true != 0)),
        "r2_vs_zero": 1 - F.try_divide(F.sum((true - pred) * (true - pred)), F.sum(true * true)),
    }


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """All nine pairs of classes with their counts, zeros included."""
    counts = df.groupBy().agg(*[F.count_if((F.col(true) == a) & (F.col(pred) == b)).alias(f"{a}|{b}") for a in CLASSES for b in CLASSES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(a).alias("true"), F.lit(b).alias("pred"), F.col(f"{a}|{b}").alias("n")) for a in CLASSES for b in CLASSES])))


def block_draws(spark, n: int, block: int, reps: int, seed: int) -> DataFrame:
    """(rep, k, start): the starts of the blocks of each resample of ``n`` rows, hashed from the seed and their numbers."""
    each = math.ceil(n / block)
    drawn = spark.range(reps * each).select((F.col("id") / each).cast("int").alias("rep"), (F.col("id") % each).cast("int").alias("k"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "k")), 1, 12), 16, 10).cast("long")
    return drawn.select("rep", "k", (hashed % max(1, n - block + 1)).cast("int").alias("start"))


def resampled(df: DataFrame, block: int, reps: int, seed: int) -> DataFrame:
    """Rows of ``reps`` resamples by blocks, with ``rep``; df has a row number ``i`` from 0.

    A resample has as many rows as the table: the last block is cut.
    """
    n = df.count()
    drawn = block_draws(df.sparkSession, n, block, reps, seed)
    rows = drawn.select("rep", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"), "k", "start").where(F.col("k") * block + F.col("o") < n)
    return rows.select("rep", (F.col("start") + F.col("o")).alias("i")).join(df.withColumn("i", F.col("i").cast("int")), "i")


def bootstrap_gain(df: DataFrame, true: str, a: str, b: str, block: int = 10, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, gain): macro F1 of b minus that of a over the same resampled blocks of rows."""
    picked = resampled(df.select("i", true, a, b), block, reps, seed)
    return picked.groupBy("rep").agg((macro_f1(F.col(true), F.col(b)) - macro_f1(F.col(true), F.col(a))).alias("gain"))


def interval(gains: DataFrame) -> DataFrame:
    """Mean, 95 % interval and share of resamples without a gain."""
    return gains.agg(F.avg("gain").alias("mean"), F.percentile("gain", 0.025).alias("low"), F.percentile("gain", 0.975).alias("high"), F.avg((F.col("gain") <= 0).cast("int")).alias("p_no_gain"))


def ranked(df: DataFrame, *columns: str, group: list[str] | None = None) -> DataFrame:
    """Columns replaced by their average ranks; the correlation of ranks is Spearman's."""
    return df.withColumns({c: N.average_rank(c, group) for c in columns})


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value by the t approximation, its tail integrated numerically."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if abs(rho) >= 1 else float("nan")
    t, v = abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2
    theta = np.linspace(math.atan(t / math.sqrt(v)), math.pi / 2, 20001)
    scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
    return float(min(1.0, 2 * scale * np.trapezoid(np.cos(theta) ** (v - 1), theta)))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial test of b against c discordant rows."""
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def terciles(df: DataFrame, value: str, by: str = "tercile") -> DataFrame:
    """Low, mid, high by linear quantile edges, right-closed."""
    edges = df.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    joined = df.crossJoin(F.broadcast(edges))  # one row of edges
    v = F.col(value)
    return joined.withColumn(by, F.when(v <= F.col("e")[0], "low").when(v <= F.col("e")[1], "mid").when(v.isNotNull(), "high")).drop("e")


def total_variation(p: list[Column], q: list[Column]) -> Column:
    return 0.5 * sum((F.abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)), F.abs(p[0] - q[0]))


def argmax_label(p: list[Column], labels: tuple[str, ...] = CLASSES) -> Column:
    """Label of the largest probability, the first of equals."""
    out, top = F.lit(None), F.greatest(*p)
    for c, label in reversed(list(zip(p, labels, strict=True))):
        out = F.when(c == top, label).otherwise(out)
    return out


def late_blend(time: list[Column], text: list[Column], weight: Column, eps: float = 1e-6) -> list[Column]:
    """Log-linear blend of two probability vectors, normalised; weight 0 is the first."""
    logs = [(1 - weight) * F.ln(a + eps) + weight * F.ln(b + eps) for a, b in zip(time, text, strict=True)]
    top = F.greatest(*logs)
    e = [F.exp(x - top) for x in logs]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labels; null with fewer than two categories."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    one = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    two = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    same = cells.where("a = b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("ns"))
    m = one.join(two, "c", "full").join(same, "c", "left").na.fill(0)
    s = m.agg(F.sum("na").alias("t"), F.sum("ns").alias("s"), F.sum(F.col("na") * F.col("nb")).alias("e"), F.count("*").alias("k"))
    po, pe = F.col("s") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return s.select(F.when(F.col("k") >= 2, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their mean rank."""
    r = df.select(F.col(label).alias("y"), N.average_rank(score).alias("r"))
    pos, all_ = F.count_if(F.col("y") == 1), F.count("*")
    return r.agg(F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("r"))) - pos * (pos + 1) / 2.0, pos * (all_ - pos)).alias("auc"))


def news_gain(results: DataFrame, base: str, other: str, keys: tuple[str, ...] = ("model", "split"), metric: str = "macro_f1") -> DataFrame:
    """Paired difference of a metric between two feature sets."""
    a = results.where(F.col("features") == base).select(*keys, F.col(metric).alias("base"))
    b = results.where(F.col("features") == other).select(*keys, F.col(metric).alias("other"))
    return a.join(b, list(keys)).withColumn("gain", F.col("other") - F.col("base"))


def best_per_group(df: DataFrame, group: str, score: str, *ties: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), *ties))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
