"""Cases of reviews that queries once got wrong, against values worked out apart."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M


def test_logistic_without_some_classes(spark):
    """Quiet series lack classes: those have probability 0, and a lone class has 1."""
    rows = [(float(i % 7), ("DOWN", "FLAT", "UP")[(i % 7) // 3]) for i in range(70)]
    df = spark.createDataFrame(rows, "x double, y string")
    for seen in (("FLAT",), ("DOWN", "FLAT"), ("FLAT", "UP"), ("DOWN", "UP"), ("DOWN", "FLAT", "UP")):
        got = M.probabilities(M.logistic(df.where(F.col("y").isin(*seen)), ["x"], "y", 10.0), df).collect()
        assert len(got) == 70
        for r in got:
            p = {c: r[f"p_{c}"] for c in ("DOWN", "FLAT", "UP")}
            assert sum(p.values()) == pytest.approx(1) and all((p[c] > 0) == (c in seen) for c in p)
            if r["y"] in seen and r["x"] in (0.0, 6.0):
                assert max(p, key=p.get) == r["y"]
    none = M.probabilities(M.logistic(df.where("y = 'x'"), ["x"], "y", 10.0), df).collect()
    assert len(none) == 70 and {r["p_UP"] for r in none} == {None}


def test_chart_scan_keeps_the_order_of_keys(spark, tmp_path):
    """The last close of a day is that of its largest key, however far apart keys are."""
    from tidemark.queries.registry import QUERIES

    rows = [(k, float(k), f"1998-02-{1 + k % 3:02d} 05:00:00", f"p{k % 2}") for k in (1, 7, 79_999, 80_001, 86_401, 160_003, 240_011, 9_000_007, 9_000_010, 9_080_002)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, at string, o_orderpriority string")
    df.withColumn("o_orderdate", F.col("at").cast("timestamp_ntz")).drop("at").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for k, price, at, p in sorted(rows):
        if k % 5:
            want[p, at[:10]] = price
    assert {(r["ticker"], str(r["date"])): r["value"] for r in QUERIES["chart_scan"](spark, str(tmp_path)).collect()} == want


def test_chart_points_of_one_time(spark):
    """Of points of one time the later in the payload counts; a null close never does."""
    from tidemark.sources import series as R

    chart = lambda ts, close: json.dumps({"chart": {"result": [{"timestamp": ts, "indicators": {"quote": [{"close": close}]}}]}})
    df = spark.createDataFrame([("a", chart([60, 60, 60, 60], [3.0, 9.0, 1.0, None])), ("b", chart([70, 60], [2.0, 5.0]))], "ticker string, payload string")
    assert {r["ticker"]: r["value"] for r in R.parse_chart(df).collect()} == {"a": 1.0, "b": 2.0}


def texts_of_words(spark):
    """Rows of 0 to 40 distinct words, with repeated and null keys."""
    words = [f"w{(i * i) % 61}" for i in range(400)]
    rows = [(None if i % 17 == 0 else i // 2 if i % 5 == 0 else 1000 + i, words[i : i + i % 41]) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, w array<string>")


def brute_information(rows, least, alpha):
    """All pairs of rows of a key, one by one."""
    from collections import Counter
    from math import log

    own, n = {}, Counter()
    for key, words in rows:
        n.update(set(words))
        own.setdefault(key, []).extend(set(words))
    own.pop(None)
    pairs = Counter((a, b) for ws in own.values() for a in ws for b in ws if a != b and n[a] >= least and n[b] >= least)
    margin = Counter()
    for (a, _), k in pairs.items():
        margin[a] += k
    t, ta = sum(margin.values()), sum(k**alpha for k in margin.values())
    out = {(a, b): log((k / t) / ((margin[a] / t) * (margin[b] ** alpha / ta))) for (a, b), k in pairs.items()}
    return {p: x for p, x in out.items() if x > 0}


def test_ppmi_is_counted_in_cells(spark, monkeypatch):
    """Many small cells and portions give the pairs of brute force, and far fewer rows than pairs are shuffled."""
    from tidemark.operators import pairs as P

    for name, size in (("CELL", 500), ("SORTED", 700), ("LISTED", 90), ("ROWS", 50)):
        monkeypatch.setattr(P, name, size)
    rows, df = texts_of_words(spark)
    found = P.Pairs(df, "id", F.col("w"), 8, 0.75)
    assert found.blocks > 5 and found.met().count() < found.t / 8
    got = {(r["w"], r["c"]): r["pmi"] for r in M.ppmi(df, "id", F.col("w"), 8).collect()}
    assert got == pytest.approx(brute_information(rows, 8, 0.75))
    assert M.ppmi(df.where("id < 0"), "id", F.col("w"), 8).count() == 0 == M.word_vectors(df.where("id < 0"), "id", F.col("w"), 3, 8).count()


def test_packed_counts():
    import numpy as np

    from tidemark.operators import pairs as P

    for places in ([], [0], [5, 6, 1 << 20], [3, 1 << 40, (1 << 40) + 1]):
        counts = np.arange(len(places)) * 3_000_000_000 + 1
        a, b = P.unpacked(P.packed(np.array(places, np.int64), counts))
        assert a.tolist() == places and b.tolist() == counts.tolist()


def test_word_vectors_of_packed_cells(spark, monkeypatch):
    """Subspace iteration over cells gives what numpy gives on the whole matrix."""
    import numpy as np

    from tidemark.operators import pairs as P

    monkeypatch.setattr(P, "CELL", 2000)
    rows, df = texts_of_words(spark)
    pmi = brute_information(rows, 8, 0.75)
    words = sorted({w for pair in pmi for w in pair})
    a = np.zeros((len(words), len(words)))
    for (w, c), x in pmi.items():
        a[words.index(w), words.index(c)] += x / 2
        a[words.index(c), words.index(w)] += x / 2
    got = {r["w"]: np.array(r["vector"]) for r in M.word_vectors(df, "id", F.col("w"), 3, 8, iterations=12).collect()}
    assert sorted(got) == words
    x = np.array([[r[f"x{k}"] for k in range(3)] for r in spark.createDataFrame([(w,) for w in words], "w string").select(*[(F.pmod(F.xxhash64("w", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0 - 0.5).alias(f"x{k}") for k in range(3)]).collect()])
    for _ in range(12):
        y = a @ x
        s, u = np.linalg.eigh(y.T @ y)
        s, u = s[::-1], u[:, ::-1]
        turn = u / np.sqrt(s)
        turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(3)] < 0, -1, 1)
        x = y @ turn
    x = x * np.sqrt(np.sqrt(s))
    want = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([got[w] for w in words], want, atol=1e-6)
