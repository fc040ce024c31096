"""Queries of whole experiments: search with a refit, suites over feature sets, probes, word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as E
from ..operators import models as M
from ..operators import vectors as V
from .base import query, r6, table
from .evaluation import predictions
from .models import talk

SETS = {"A": ["p"], "B": ["p", "n"], "C": ["p", "n", "price"]}


def panel(spark, d):
    return predictions(spark, d).select("date", "ret", "p", F.col("n").cast("double").alias("n"), "price", "split").cache()


@query()
def grid_ridge(spark, d):
    """Ridge strength chosen on validation rows, refitted on both, test rows predicted once."""
    setting, error, _, test = E.searched(panel(spark, d), SETS["C"], "ret", "ridge", (0.1, 10.0, 1000.0))
    return test.select("date", "ret", r6("prediction", "prediction"), F.lit(E.settings_json("ridge", setting)).alias("params"), F.lit(error).alias("val_rmse"))


@query()
def regression_suite(spark, d):
    """Feature sets A, B and C under ridge and boosted trees, on validation and test rows."""
    return E.regression_suite(panel(spark, d), SETS, "ret", {"ridge": (1.0, 100.0), "trees": ((5, 2),)})


@query()
def magnitude_ablation(spark, d):
    """Feature sets on the size of the move, with the interval of the gain over the first."""
    return E.magnitude_ablation(panel(spark, d), SETS, "ret", "date")


@query()
def volatility_probe(spark, d):
    """Vectors of the calmest and most volatile days told apart by a linear probe."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 60).alias("day"), "embedding", "label")
    days = e.groupBy("day").agg(F.stddev_samp("label").alias("volatility"))
    return E.volatility_probe(e.select("vec_id", "day", "embedding"), days, "embedding", "vec_id", F.lit(1.0))


@query()
def feature_importance(spark, d):
    _, model = M.ridge(panel(spark, d).where("split = 'train'"), SETS["C"], "ret", 10.0)
    return spark.createDataFrame(V.importance(SETS["C"], model), "feature string, importance double")


@query()
def drift_model_auc(spark, d):
    """How well a model tells training days from test days by their features."""
    p = panel(spark, d).where("split <> 'val'")
    return spark.createDataFrame([(V.drift_auc(p, SETS["C"], F.col("split") == "train", "date"),)], "auc double")


@query()
def word_vectors(spark, d):
    """Unit vectors of words from the leading eigenvectors of their mutual information."""
    return M.word_vectors(talk(spark, d), "id", F.col("w"), 8, 8)


@query()
def sampled_topics(spark, d):
    """Topics fitted on a hashed sample of the training rows; every row gets one."""
    e = table(spark, d, "embeddings")
    return M.topics(M.fit_sample(e.where("label IS NOT NULL"), 400, 42, "vec_id"), e, "embedding", 5).select("vec_id", "topic")


@query()
def arma_forecast(spark, d):
    """One-step forecasts of the returns by an ARMA model chosen on the early rows."""
    p = predictions(spark, d).select(F.lit("y").alias("series"), "date", "ret")
    return M.arma_forecast(p, "series", "date", "ret", tuple((p, q) for p in range(3) for q in range(3)), "1999-01-01")
