"""Experiments, sinks, the encoder contract, long decays and skewed de-duplication, against values worked out apart."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup as P
from tidemark.operators import evaluation as V
from tidemark.operators import experiments as E
from tidemark.operators import vectors as B
from tidemark.operators import windows as N
from tidemark.sources import series as R


def test_decay_of_a_long_series(spark):
    x = [None if i % 7 == 3 else float(i % 11) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    got = [r[0] for r in N.ewm_mean(df, F.col("x"), "m", "i", 1.5).orderBy("i").select("m").collect()]
    want = pd.Series(x).ewm(halflife=1.5, ignore_na=True).mean()
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_dataset_and_samples(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, g int")
    R.write_dataset(df, str(tmp_path / "d"), rows=F.count("*"))
    assert R.read_dataset(spark, str(tmp_path / "d")).count() == 20
    built = R.read_manifest(spark, str(tmp_path / "d"))
    assert built["rows"] == 20 and R.write_sample(df, ["g"], 3, 1, "id", str(tmp_path / "s"), built, 20) == 6
    for bad in ({"rows": 19}, built | {"synthetic": True}):
        with pytest.raises(ValueError):
            R.write_sample(df, ["g"], 3, 1, "id", str(tmp_path / "s"), bad, 20)


def test_encoder_contract(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None), (3, "c")], "id long, text string")
    got = {r["id"]: list(r["vector"]) for r in B.encoded(df, "id", "text", lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()}
    assert got == {1: [4.0, 1.0], 2: [0.0, 0.0], 3: [1.0, 1.0]}


def test_search_refits_and_suites(spark):
    rows = [(i, float(i % 7), float(i % 5), 2.0 * (i % 7) - 1.0 + (i % 3) * 0.01, "train" if i < 60 else "val" if i < 80 else "test") for i in range(120)]
    df = spark.createDataFrame(rows, "i int, x double, z double, y double, split string")
    setting, error, val, test = E.searched(df, ["x", "z"], "y", "ridge", (1e-6, 1000.0))
    assert setting == 1e-6 and error < 0.1 and val.count() == 20 and test.count() == 40
    suite = E.regression_suite(df, {"A": ["z"], "B": ["x", "z"]}, "y", {"ridge": (0.1,), "trees": ((3, 2),)}).collect()
    assert len(suite) == 8 and {r["params"] for r in suite} == {'{"alpha": 0.1}', '{"trees": 3, "depth": 2}'}
    out = {r["set"]: r for r in E.magnitude_ablation(df, {"A": ["z"], "B": ["x", "z"]}, "y", "i", (0.1, 10.0), 50).collect()}
    assert out["B"]["test_rmse"] < out["A"]["test_rmse"] and out["A"]["low"] is None and out["B"]["low"] > 0


def test_probe_tells_calm_from_volatile(spark):
    days = spark.createDataFrame([(d, float(d)) for d in range(200)], "day int, volatility double")
    arts = spark.createDataFrame([(d * 10 + k, d, [d / 40.0 + k / 100.0, k / 10.0]) for d in range(200) for k in range(3)], "id int, day int, v array<double>")
    r = E.volatility_probe(arts, days, "v", "id", F.lit(1.0)).first()
    assert r["n_high_days"] == r["n_low_days"] == 30 and r["article_auc"] > 0.95 and r["day_auc"] > 0.95


def test_resamples_have_all_rows(spark):
    df = spark.range(25).select(F.col("id").alias("i"), F.lit("UP").alias("t"))
    n = [r["count"] for r in V.resampled(df, 10, 7, 3).groupBy("rep").count().collect()]
    assert n == [25] * 7


def test_dedup_keeps_every_row_and_splits_a_common_title(spark):
    """Half of the rows have one title; keys repeat and are null, times are null; windows are anchored."""
    rows = [("k" if i % 3 else None, "Markets wrap: stocks close higher", f"http://a/{i}", 3600 * i if i % 5 else None) for i in range(300)]
    rows += [(f"u{i}", f"A title of its own number {i} about something else {i * 7919}", "http://same/x?utm_a=1" if i < 3 else f"http://b/{i}", 500_000_000 + i * 10**6) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, title string, url string, t long").withColumn("seen", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = P.deduplicate(df, "id", "title", "url", "seen", most=0).collect()
    assert len(got) == 340
    anchors, at = 0, None
    for t in sorted(r[3] for r in rows[:300] if r[3] is not None):
        if at is None or t - at > 48 * 3600:
            at, anchors = t, anchors + 1
    wrap = [r for r in got if r["title"].startswith("Markets")]
    # windows touch each other through pairs of equal fingerprints, as rows are an hour apart: one cluster of timed rows, untimed ones alone
    assert sorted({r["dup_count"] for r in wrap}) == [1, 240] and sum(not r["is_duplicate"] for r in wrap) == 61
    assert sorted(r["dup_count"] for r in got if r["url"].startswith("http://same")) == [3, 3, 3]
    edges = P.title_edges(spark.createDataFrame([("x", t * 3600, t) for t in range(120)], "norm string, t long, id long"))
    assert {r["root"] for r in edges.collect()} == {0, 49, 98} and edges.count() == 117


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "id long, root long")
    nodes = spark.range(301).union(spark.createDataFrame([(1000,), (1001,), (5000,)], "id long"))
    got = {r["id"]: r["root"] for r in P.components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 5000: 5000}


def test_arma_recovers_its_parameters(spark):
    import numpy as np

    from tidemark.operators import models as M

    r = np.random.default_rng(7)
    e = r.normal(size=3000)
    y = np.zeros(3000)
    for t in range(1, 3000):
        y[t] = 0.3 + 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    w, rss = M.arma_fit(y, 1, 1)
    assert abs(w[1] - 0.6) < 0.06 and abs(w[2] - 0.4) < 0.06 and abs(rss / 3000 - 1) < 0.08
    days = pd.date_range("2010-01-01", periods=600)
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "d": days.date, "y": y[:600]}))
    got = M.arma_forecast(df, "s", "d", "y", ((0, 0), (1, 0), (1, 1)), "2011-03-01").orderBy("d").toPandas()
    assert (got.p[0], got.q[0]) == (1, 1)
    later = df.withColumn("y", F.when(F.col("d") >= "2011-08-01", 99.0).otherwise(F.col("y")))
    again = M.arma_forecast(later, "s", "d", "y", ((1, 1),), "2011-03-01").orderBy("d").toPandas()
    early = pd.to_datetime(got.d) <= "2011-08-01"  # the day's forecast has seen only earlier days
    assert np.allclose(got.forecast[early][1:], again.forecast[early][1:], equal_nan=True)
