"""Baselines, linear models and vector features; every fit takes the rows it may see."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import CLASSES
from .pairs import Pairs, information, leading


def majority(train: DataFrame, label: str) -> DataFrame:
    """The most frequent label of the training rows, the first in order of equals: one row."""
    return train.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("majority"))


class Scaler:
    """Median for missing values, then zero mean and unit population spread, learnt from the rows fitted."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        self.columns = columns
        med = rows.agg(*[F.median(c).alias(c) for c in columns]).first()
        self.median = {c: med[c] if med[c] is not None else 0.0 for c in columns}
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(self.median[c]))) for c in columns]
        s = rows.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
        self.mean, self.std = [s[f"m{i}"] for i in range(len(columns))], [s[f"s{i}"] or 1.0 for i in range(len(columns))]

    def transform(self, rows: DataFrame) -> DataFrame:
        x = [(F.coalesce(F.col(c).cast("double"), F.lit(float(self.median[c]))) - m) / s for c, m, s in zip(self.columns, self.mean, self.std, strict=True)]
        return rows.withColumn("features", array_to_vector(F.array(*x)))


def ridge(train: DataFrame, columns: list[str], label: str, alpha: float):
    """Ridge regression of scaled columns with a free intercept; returns (scaler, model)."""
    scaler = Scaler(train, columns)
    s = train.agg(F.stddev_samp(label).alias("sd"), F.stddev_pop(label).alias("sp"), F.count(label).alias("n")).first()
    model = LinearRegression(labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * (s["sp"] or 1.0) / s["n"]).fit(scaler.transform(train))
    return scaler, model


def logistic(train: DataFrame, columns: list[str], label: str, c: float):
    """Multinomial logistic regression with balanced class weights; returns (scaler, model, classes).

    ``classes`` are those of CLASSES that training rows have, in that order: a quiet
    series may lack some. Of one class alone, or none, there is no model. Rows without
    a class are not fitted.
    """
    train = train.where(F.col(label).isin(*CLASSES))
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # three classes
    classes = [name for name in CLASSES if name in counts]
    if len(classes) < 2:
        return None, None, classes
    scaler, n = Scaler(train, columns), sum(counts.values())
    code, weight = F.lit(None).cast("double"), F.lit(0.0)
    for i, name in enumerate(classes):
        code = F.when(F.col(label) == name, float(i)).otherwise(code)
        weight = F.when(F.col(label) == name, n / (len(classes) * counts[name])).otherwise(weight)
    rows = scaler.transform(train).withColumns({"_y": code, "_w": weight})
    return scaler, LogisticRegression(labelCol="_y", weightCol="_w", family="multinomial", standardization=False, regParam=1 / (c * n), maxIter=200, tol=1e-9).fit(rows), classes


def probabilities(fitted, rows: DataFrame) -> DataFrame:
    """Rows with p_DOWN, p_FLAT and p_UP: 0 for a class that was not fitted, null if none was."""
    scaler, model, classes = fitted
    if model is None:
        return rows.withColumns({f"p_{c}": F.lit(float(c in classes) if classes else None).cast("double") for c in CLASSES})
    p = vector_to_array("probability")
    return model.transform(scaler.transform(rows)).withColumns({f"p_{c}": p[classes.index(c)] if c in classes else F.lit(0.0) for c in CLASSES})


def grid_search(kinds: dict[str, object], score) -> tuple[str, dict[str, float]]:
    """Fit once a setting, on training rows only, and name the best validation score, the first of equals."""
    scores = {name: score(fit) for name, fit in kinds.items()}
    return max(scores, key=lambda k: scores[k]), scores


def boosted(train: DataFrame, columns: list[str], label: str, trees: int = 20, depth: int = 3, seed: int = 42):
    """One boosted tree model a class against the rest: Spark has no multiclass boosting. Returns (scaler, models)."""
    from pyspark.ml.classification import GBTClassifier

    scaler = Scaler(train, columns)
    rows = scaler.transform(train)
    return scaler, [GBTClassifier(labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed).fit(rows.withColumn("_y", (F.col(label) == c).cast("double"))) for c in CLASSES]


def boosted_probabilities(fitted, rows: DataFrame) -> DataFrame:
    scaler, models = fitted
    out = scaler.transform(rows)
    for c, m in zip(CLASSES, models, strict=True):
        out = m.transform(out).withColumn(f"_{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    total = sum((F.col(f"_{c}") for c in CLASSES[1:]), F.col(f"_{CLASSES[0]}"))
    return out.withColumns({f"p_{c}": F.col(f"_{c}") / total for c in CLASSES}).drop(*[f"_{c}" for c in CLASSES])


def ar_forecast(series: DataFrame, key: str, date: str, value: str, orders: tuple[int, ...], fit_before: str) -> DataFrame:
    """One-step autoregressive forecasts by series, order chosen by AIC on rows before ``fit_before``, parameters then frozen.

    Least squares stands in for maximum likelihood. A forecast uses earlier rows only.
    A series is day-grain and small; it is fitted in one task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        y, early = pdf[value].to_numpy(float), (pd.to_datetime(pdf[date]) < pd.Timestamp(fit_before)).to_numpy()
        best = None
        for p in orders:
            lags = np.stack([np.ones(len(y))] + [np.concatenate([np.full(k, np.nan), y[:-k]]) for k in range(1, p + 1)], 1)
            own = early & np.isfinite(lags).all(1) & np.isfinite(y)
            if own.sum() <= p + 1:
                continue
            w, *_ = np.linalg.lstsq(lags[own], y[own], rcond=None)
            rss = float(((y[own] - lags[own] @ w) ** 2).sum())
            aic = own.sum() * np.log(max(rss, 1e-12) / own.sum()) + 2 * (p + 1)
            if best is None or aic < best[0]:
                best = aic, p, lags @ w
        return pd.DataFrame({key: pdf[key], date: pdf[date], "p": best[1] if best else None, "forecast": best[2] if best else np.nan})

    kind = dict(series.dtypes)
    return series.select(key, date, value).groupBy(key).applyInPandas(one, f"{key} {kind[key]}, {date} {kind[date]}, p int, forecast double")


def arma_residuals(w: np.ndarray, y: np.ndarray, p: int, q: int) -> np.ndarray:
    """One-step errors of an ARMA(p, q) with weights (constant, p lags, q past errors); the first p rows are given, errors before them 0."""
    n = len(y)
    e = np.zeros(n)
    e[p:] = y[p:] - w[0] - sum((w[k] * y[p - k : n - k] for k in range(1, p + 1)), np.zeros(n - p))
    if q:
        theta, out = w[p + 1 :].tolist(), e.tolist()
        for t in range(p, n):
            for j, c in enumerate(theta, 1):
                if t - j >= p:
                    out[t] -= c * out[t - j]
        e = np.array(out)
    return e


def arma_fit(y: np.ndarray, p: int, q: int, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights of least conditional sum of squares, by damped Gauss-Newton steps, and that sum."""
    w = np.zeros(1 + p + q)
    w[0], damp = y.mean(), 1e-3
    e = arma_residuals(w, y, p, q)
    best = float(e @ e)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(w), 1e-2)
        jac = np.stack([(arma_residuals(w + step * (np.arange(len(w)) == k), y, p, q) - e) / step[k] for k in range(len(w))], 1)
        a, g = jac.T @ jac, jac.T @ e
        for _ in range(8):
            new = w - np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
            with np.errstate(over="ignore", invalid="ignore"):
                tried = arma_residuals(new, y, p, q)
                now = float(tried @ tried)
            if np.isfinite(now) and now < best and np.abs(new[p + 1 :]).sum() < 2:
                damp /= 4
                break
            damp *= 4
        else:
            break
        gain, w, e, best = best - now, new, tried, now
        if gain <= 1e-10 * best:
            break
    return w, best


def arma_forecast(series: DataFrame, key: str, date: str, value: str, orders: tuple[tuple[int, int], ...], fit_before: str) -> DataFrame:
    """One-step ARMA forecasts by series: order (p, q) chosen by AIC on rows before ``fit_before``, parameters then frozen.

    Parameters have the least conditional sum of squares. A forecast uses earlier rows
    only; rows without a value are left out. A series is day-grain and small; it is
    fitted in one task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(date)
        y, n = pdf[value].to_numpy(float), int((pd.to_datetime(pdf[date]) < pd.Timestamp(fit_before)).sum())
        best = None
        for p, q in orders:
            if n > 2 * (p + q + 1):
                w, rss = arma_fit(y[:n], p, q)
                aic = n * np.log(max(rss, 1e-12) / n) + 2 * (p + q + 1)
                if best is None or aic < best[0]:
                    best = aic, p, q, w
        out = pd.DataFrame({key: pdf[key], date: pdf[date]})
        if best is None:
            return out.assign(p=None, q=None, forecast=np.nan)
        forecast = y - arma_residuals(best[3], y, best[1], best[2])
        forecast[: best[1]] = np.nan
        return out.assign(p=best[1], q=best[2], forecast=forecast)

    kind = dict(series.dtypes)
    return series.select(key, date, value).groupBy(key).applyInPandas(one, f"{key} {kind[key]}, {date} {kind[date]}, p int, q int, forecast double")


def pooled(df: DataFrame, group: Column, vector: str, weight: Column) -> DataFrame:
    """(day, pos, x): weighted mean of vectors, an element a row; partial sums before the shuffle."""
    e = df.select(group.alias("day"), weight.alias("w"), F.posexplode(vector).alias("pos", "v"))
    return e.groupBy("day", "pos").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("x"))


def vectors_of(long: DataFrame) -> DataFrame:
    """(day, vector) from (day, pos, x)."""
    return long.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def l2_norm(vector: Column) -> Column:
    """A vector of unit length; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def pca(train: DataFrame, rows: DataFrame, vector: str, k: int) -> DataFrame:
    """Scores on components of the training rows' centred vectors; vectors with nulls are not fitted and get null."""
    n = train.select(F.size(vector).alias("n")).where("n > 0").first()["n"]
    whole = ~F.exists(vector, lambda x: x.isNull()) & F.col(vector).isNotNull()
    mean = train.where(whole).agg(*[F.avg(F.col(vector)[i]).alias(f"m{i}") for i in range(n)]).first()
    centred = array_to_vector(F.array(*[F.col(vector)[i].cast("double") - F.lit(float(mean[f"m{i}"])) for i in range(n)]))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(train.where(whole).withColumn("_c", centred))
    scored = model.transform(rows.where(whole).withColumn("_c", centred)).withColumn("scores", vector_to_array("_p")).drop("_c", "_p")
    return scored.unionByName(rows.where(~F.coalesce(whole, F.lit(False))).withColumn("scores", F.lit(None).cast("array<double>")))


def topics(train: DataFrame, rows: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    own = lambda df: df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="topic").fit(own(train)).transform(own(rows)).drop("_v")


def gram(rows: DataFrame, vector: str, n: int) -> np.ndarray:
    """The n x n sums of products of vector elements; a partition adds its rows up itself, so n rows of n numbers a partition are shuffled."""

    def sums(frames):
        total = np.zeros((n, n))
        for frame in frames:
            if len(frame):
                x = np.stack(frame[vector].to_numpy()).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(n), "g": list(total)})

    parts = rows.select(vector).mapInPandas(sums, "i int, g array<double>")
    out = parts.groupBy("i").agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(n)]).orderBy("i").collect()  # n rows
    return np.array([r[1:] for r in out], float)


def svd(rows: DataFrame, vector: str, k: int, key: str) -> DataFrame:
    """(key, scores): uncentred truncated SVD, from the Gram matrix of the columns, whose size is the vectors' width."""
    n = rows.select(F.size(vector).alias("n")).where("n > 0").first()["n"]
    _, v = np.linalg.eigh(gram(rows, vector, n))
    top = v[:, ::-1][:, :k]
    top = top * np.where(top[np.abs(top).argmax(0), np.arange(k)] < 0, -1, 1)
    scores = F.array(*[sum((F.col(vector)[i].cast("double") * float(top[i, c]) for i in range(1, n)), F.col(vector)[0].cast("double") * float(top[0, c])) for c in range(k)])
    return rows.select(key, scores.alias("scores"))


def tfidf(df: DataFrame, key: str, terms: Column, fit: Column, min_df: int = 2, max_share: float = 0.5) -> DataFrame:
    """(key, term, weight): sublinear counts by smooth idf of the fitted rows, each row of unit length.

    Terms rarer than ``min_df`` or in more than ``max_share`` of the fitted rows are left out.
    """
    n = df.where(fit).count()
    tf = df.select(key, fit.alias("_fit"), F.explode(terms).alias("term")).groupBy(key, "_fit", "term").agg(F.count("*").alias("tf"))
    df_ = tf.where("_fit").groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n))
    w = tf.join(df_, "term").withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def ppmi(df: DataFrame, key: str, terms: Column, min_count: int = 5, alpha: float = 0.75) -> DataFrame:
    """(w, c, pmi): positive pointwise mutual information of terms that share a row, contexts smoothed by ``alpha``.

    Pairs are counted in cells of a packed matrix, see :mod:`.pairs`.
    """
    return information(Pairs(df, key, terms, min_count, alpha))


def word_vectors(df: DataFrame, key: str, terms: Column, width: int, min_count: int = 5, alpha: float = 0.75, iterations: int = 20) -> DataFrame:
    """(w, vector): unit vectors U * sqrt(S) of the symmetric part of :func:`ppmi`'s sparse matrix, by subspace iteration."""
    return leading(Pairs(df, key, terms, min_count, alpha), width, iterations).select("w", l2_norm(F.col("x")).alias("vector"))


def fit_sample(rows: DataFrame, most: int, seed: int, key: str) -> DataFrame:
    """At most ``most`` rows to fit a model on, the same at any partitioning."""
    from .sampling import hashed

    return hashed(rows, most, seed, key)


def topic_terms(df: DataFrame, topic: str, terms: Column, top: int = 8) -> DataFrame:
    """(topic, term, score, rank): class-based tf-idf labels, tf by ln(1 + mean topic size / count in all topics)."""
    c = df.select(topic, F.explode(terms).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("n"))
    sizes = c.groupBy(topic).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    all_ = c.groupBy("term").agg(F.sum("n").alias("total"))
    s = c.join(all_, "term").join(sizes, topic).crossJoin(F.broadcast(mean)).withColumn("score", F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("total")))  # one row
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.desc(F.round("score", 9)), "term"))
    return s.withColumn("rank", rank).where(F.col("rank") <= top).select(topic, "term", "score", "rank")
