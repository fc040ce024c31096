"""Whole experiments on a panel with a chronological ``split``: settings chosen on validation rows, one refit, one read of the test rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation as V
from . import models as M


def ridge_fit(alpha: float, train: DataFrame, columns: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
    scaler, model = M.ridge(train, columns, label, alpha)
    return lambda rows: model.transform(scaler.transform(rows))


def trees_fit(setting: tuple[int, int], train: DataFrame, columns: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """Boosted regression trees; setting: number of trees, depth."""
    scaler = M.Scaler(train, columns)
    model = GBTRegressor(labelCol=label, maxIter=setting[0], maxDepth=setting[1], seed=42).fit(scaler.transform(train))
    return lambda rows: model.transform(scaler.transform(rows))


FITS = {"ridge": (ridge_fit, ("alpha",)), "trees": (trees_fit, ("trees", "depth"))}


def _rmse(rows: DataFrame, label: str) -> float:
    return rows.agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2))).first()[0]


def searched(df: DataFrame, columns: list[str], label: str, kind: str, grid: Iterable) -> tuple[object, float, DataFrame, DataFrame]:
    """The best setting of ``grid`` and its validation error, and the predicted validation and test rows.

    Every setting is fitted on training rows and scored on validation rows; the best, the
    first of equals, is fitted again on both, and only then are test rows predicted.
    """
    fit, (train, val, test) = FITS[kind][0], (df.where(F.col("split") == s) for s in ("train", "val", "test"))
    best = None
    for setting in grid:
        predicted = fit(setting, train, columns, label)(val)
        error = _rmse(predicted, label)
        if best is None or error < best[1]:
            best = setting, error, predicted
    final = fit(best[0], train.unionByName(val), columns, label)(test)
    return best[0], best[1], best[2], final


def settings_json(kind: str, setting) -> str:
    """The cell of a result table that names a setting."""
    values = setting if isinstance(setting, tuple) else (setting,)
    return json.dumps(dict(zip(FITS[kind][1], values, strict=True)))


def regression_suite(df: DataFrame, sets: dict[str, list[str]], label: str, grids: dict[str, Iterable]) -> DataFrame:
    """(experiment, model, split, params, rmse, mae, directional, r2_vs_zero) of each feature set and kind of model."""
    out = None
    for name, columns in sets.items():
        for kind, grid in grids.items():
            setting, _, val, test = searched(df, columns, label, kind, grid)
            for split, rows in (("val", val), ("test", test)):
                scores = rows.agg(*[c.alias(n) for n, c in V.regression(F.col(label), F.col("prediction")).items()])
                own = scores.select(F.lit(name).alias("experiment"), F.lit(kind).alias("model"), F.lit(split).alias("split"), F.lit(settings_json(kind, setting)).alias("params"), *scores.columns)
                out = own if out is None else out.unionByName(own)
    return out


def rmse_gains(df: DataFrame, true: str, a: str, b: str, block: int = 10, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, gain): error of a minus that of b over resampled blocks of rows; df has a row number ``i`` from 0."""
    error = lambda p: F.sqrt(F.avg((F.col(true) - F.col(p)) ** 2))
    return V.resampled(df.select("i", true, a, b), block, reps, seed).groupBy("rep").agg((error(a) - error(b)).alias("gain"))


def magnitude_ablation(df: DataFrame, sets: dict[str, list[str]], label: str, order: str, alphas: Iterable[float] = (1.0, 10.0, 100.0, 1000.0), reps: int = 1000) -> DataFrame:
    """How well feature sets predict the size of the move: a row a set with its errors, rank correlation, and the gain over the first set.

    The gain's interval comes from block resamples of the test rows; the first set has none.
    """
    sized = df.withColumn("_size", F.abs(label))
    mean = sized.where("split <> 'test'").agg(F.avg("_size")).first()[0]
    out, base = None, None
    for name, columns in sets.items():
        alpha, error, _, test = searched(sized, columns, "_size", "ridge", alphas)
        y, p = F.col("_size"), F.col("prediction")
        ranks = V.ranked(test.select("_size", "prediction"), "_size", "prediction").agg(F.corr("_size", "prediction").alias("test_spearman"))
        scores = test.agg(F.sqrt(F.avg((y - p) ** 2)).alias("test_rmse"), (1 - F.sum((y - p) ** 2) / F.sum((y - mean) ** 2)).alias("test_r2_vs_mean"))
        own = scores.crossJoin(ranks).select(F.lit(name).alias("set"), F.lit(float(alpha)).alias("alpha"), F.lit(float(error)).alias("val_rmse"), "test_rmse", "test_r2_vs_mean", "test_spearman")  # one row each
        rows = test.select(order, "_size", p.alias("_p"))
        if base is None:
            base, gain = rows, own.select(*[F.lit(None).cast("double").alias(c) for c in ("low", "high", "p_no_gain")]).limit(1)
        else:
            both = base.join(rows.select(order, F.col("_p").alias("_q")), order)
            numbered = both.withColumn("i", F.row_number().over(V.W.orderBy(order)) - 1)  # day-grain rows
            gain = V.interval(rmse_gains(numbered, "_size", "_p", "_q", reps=reps)).select("low", "high", "p_no_gain")
        own = own.crossJoin(gain)  # one row
        out = own if out is None else out.unionByName(own)
    return out


def probe_auc(rows: DataFrame, vector: str, label: str, key: str, folds: int = 5, c: float = 0.1) -> float:
    """Area under the curve of a linear probe that tells 0/1 labels from vectors, over folds by hashed key."""
    own = rows.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"), F.col(label).cast("double").alias("_y"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("_fold"))
    out = None
    for f in range(folds):
        train = own.where(F.col("_fold") != f)
        model = LogisticRegression(featuresCol="_v", labelCol="_y", standardization=False, regParam=1 / (c * max(1, train.count())), maxIter=200).fit(train)
        scored = model.transform(own.where(F.col("_fold") == f)).select("_y", vector_to_array("probability")[1].alias("_p"))
        out = scored if out is None else out.union(scored)
    return float(V.rank_auc(out, "_y", "_p").first()[0])


def volatility_probe(articles: DataFrame, days: DataFrame, vector: str, key: str, weight: Column, share: float = 0.15) -> DataFrame:
    """Can a linear probe tell the calmest from the most volatile days? One row: area under the curve for articles and for daily means.

    ``days`` (day, volatility) are training days; the top and bottom ``share`` by exact
    percentiles are compared, articles (key, day, vector) one by one and as weighted
    daily means.
    """
    known = days.where("volatility is not null")
    edge = known.agg(F.percentile("volatility", F.array(F.lit(share), F.lit(1 - share))).alias("e"))
    volatile = known.crossJoin(F.broadcast(edge)).withColumn("high", F.when(F.col("volatility") >= F.col("e")[1], 1).when(F.col("volatility") <= F.col("e")[0], 0)).where("high is not null").select("day", "high")  # one row of edges
    own = articles.join(volatile, "day")
    daily = M.vectors_of(M.pooled(own, F.col("day"), vector, weight)).join(volatile, "day")
    counts = volatile.agg(F.count_if(F.col("high") == 1).alias("n_high_days"), F.count_if(F.col("high") == 0).alias("n_low_days"))
    return counts.select(F.lit(probe_auc(own, vector, "high", key)).alias("article_auc"), F.lit(probe_auc(daily, "vector", "high", "day")).alias("day_auc"), "n_high_days", "n_low_days")
