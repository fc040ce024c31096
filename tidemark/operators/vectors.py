"""Pooling of article vectors to days, sequences for attention models, and what a fitted model leans on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import models as M
from . import windows as N


def daily_vectors(df: DataFrame, day: str, vector: str, weight: Column, mode: str = "mean", halflife: float = 3.0, score: Column | None = None) -> DataFrame:
    """(day, pos, x): a day's vector as weighted mean, as decayed mean of daily means, or by attention.

    ``attention`` weighs articles by a softmax of ``score`` within the day; ``decay``
    runs an exponentially weighted mean over days, each element on its own.
    """
    if mode == "attention":
        soft = N.softmax(F.lit(0.0) if score is None else score, W.partitionBy(day))
        return M.pooled(df.withColumn("_a", soft), F.col(day), vector, F.col("_a"))
    long = M.pooled(df, F.col(day), vector, weight)
    if mode == "mean":
        return long
    if mode != "decay":
        raise ValueError(f"unknown pooling {mode}")
    return N.ewm_mean(long.withColumnRenamed("x", "v"), F.col("v"), "x", "day", halflife, ("pos",)).select("day", "pos", "x")


def sequences(df: DataFrame, day: str, vector: str, order: list[Column], weight: Column, k: int, width: int) -> DataFrame:
    """(day, items, mask, prior): the first k vectors of a day, zero vectors after them; padding has mask 0 and prior -1e9."""
    top = N.top_k(df.withColumn("_w", F.ln(weight)), day, k, *order)
    g = top.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(vector).alias("v"), F.col("_w").alias("w")))).alias("s"))
    pad = F.lit(k) - F.size("s")
    zero = F.transform(F.array_repeat(F.lit(0), pad), lambda _: F.array_repeat(F.lit(0.0), width))
    return g.select(
        F.col(day).alias("day"),
        F.concat(F.transform("s", lambda x: F.transform(x["v"], lambda e: e.cast("double"))), zero).alias("items"),
        F.concat(F.array_repeat(F.lit(1), F.size("s")), F.array_repeat(F.lit(0), pad)).alias("mask"),
        F.concat(F.transform("s", lambda x: x["w"]), F.array_repeat(F.lit(-1e9), pad)).alias("prior"),
    )


def encoded(df: DataFrame, key: str, text: str, encode, width: int, batch: int = 64) -> DataFrame:
    """(key, vector): texts through an encoder. ``encode`` takes a list of texts and gives as many vectors of ``width`` numbers.

    This is the contract for any model: it is called in the workers, on batches sorted by
    length, as padding to the longest wastes work. Null and empty texts get zero vectors
    without a call.
    """
    import pandas as pd

    def mapped(frames):
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            out = [[0.0] * width for _ in texts]
            order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                for i, v in zip(own, encode([texts[i] for i in own]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.DataFrame({key: frame[key], "vector": out})

    return df.select(key, text).mapInPandas(mapped, f"{key} {dict(df.dtypes)[key]}, vector array<double>")


def block(vectors: list[Column], columns: list[Column]) -> Column:
    """Vectors and single columns side by side as one array of doubles; missing values are NaN, so every row keeps its width."""
    known = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))
    return F.concat(*[F.transform(v, known) for v in vectors], F.array(*[known(c) for c in columns]))


def importance(columns: list[str], model) -> list[tuple[str, float]]:
    """Columns by mean absolute coefficient, or by a tree model's own importance."""
    if hasattr(model, "featureImportances"):
        scores = [float(x) for x in model.featureImportances.toArray()]
    else:
        matrix = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else model.coefficients.toArray()[None]
        scores = [float(x) for x in abs(matrix).mean(0)]
    return sorted(zip(columns, scores, strict=True), key=lambda p: (-p[1], p[0]))


def drift_auc(df: DataFrame, columns: list[str], early: Column, key: str, folds: int = 5) -> float:
    """How well a model tells early from late rows: area under the curve over folds by hashed key, each scored by a fit on the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from .evaluation import rank_auc

    own = df.withColumns({"_y": early.cast("double"), "_fold": F.pmod(F.xxhash64(key), F.lit(folds))})
    out = None
    for f in range(folds):
        train, test = own.where(F.col("_fold") != f), own.where(F.col("_fold") == f)
        scaler = M.Scaler(train, columns)
        model = LogisticRegression(labelCol="_y", standardization=False, regParam=1.0 / max(1, train.count())).fit(scaler.transform(train))
        scored = model.transform(scaler.transform(test)).select("_y", vector_to_array("probability")[1].alias("_p"))
        out = scored if out is None else out.union(scored)
    return float(rank_auc(out, "_y", "_p").first()[0])


def top_terms(loadings: DataFrame, n: int = 12) -> DataFrame:
    """(component, side, term, loading): the most positive and most negative loadings of (component, term, loading)."""
    high = F.row_number().over(W.partitionBy("component").orderBy(F.desc("loading"), "term"))
    low = F.row_number().over(W.partitionBy("component").orderBy("loading", "term"))
    ranked = loadings.withColumns({"_h": high, "_l": low})
    return ranked.where(F.col("_h") <= n).select("component", F.lit("high").alias("side"), "term", "loading").union(ranked.where(F.col("_l") <= n).select("component", F.lit("low"), "term", "loading"))
