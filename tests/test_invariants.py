"""Decisions that would silently invalidate a study if they slipped."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import calendar as C
from tidemark.operators import dedup as P
from tidemark.operators import evaluation as V
from tidemark.operators import gates as G
from tidemark.operators import models as M
from tidemark.operators import quality as Q
from tidemark.operators import sampling as Z
from tidemark.operators import targets as T
from tidemark.operators import windows as N
from tidemark.sources import articles as S
from tidemark.sources import series as R


def day(text):
    return dt.date.fromisoformat(text)


def one(df):
    return df.first()[0]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def panel(spark, values, start="2024-01-01", name="price"):
    d = day(start)
    return frame(spark, [(d + dt.timedelta(days=i), v) for i, v in enumerate(values)], f"date date, {name} double")


def test_zone_before_date(spark):
    t = frame(spark, [("2024-03-12 18:30:00",), ("2024-03-12 16:59:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in t.orderBy(F.desc("t")).select(C.local_date(F.col("t"), "Asia/Jakarta")).collect()]
    assert got == [day("2024-03-13"), day("2024-03-12")]


def test_weekend_shares_a_bucket_and_early_rows_have_none(spark):
    cal = frame(spark, [(day("2024-03-08"),), (day("2024-03-11"),)], "td date")
    a = frame(spark, [(day(x),) for x in ("2024-03-07", "2024-03-08", "2024-03-09", "2024-03-10", "2024-03-11", "2024-03-20")], "local_date date")
    got = {r["local_date"].isoformat(): r["td"] and r["td"].isoformat() for r in C.floor_asof(a, "local_date", cal).collect()}
    assert got == {"2024-03-07": None, "2024-03-08": "2024-03-08", "2024-03-09": "2024-03-08", "2024-03-10": "2024-03-08", "2024-03-11": "2024-03-11", "2024-03-20": "2024-03-11"}
    b = {r["td"].isoformat(): (r["window_hours"], r["is_post_weekend"]) for r in C.buckets(cal).collect()}
    assert b == {"2024-03-08": (72.0, True), "2024-03-11": (24.0, False)}
    assert C.attach_news_day(a, cal).count() == 5


def test_no_contemporaneous_market_column(spark):
    f = panel(spark, [1.0, 2.0, 3.0], name="n")
    m, y = panel(spark, [10.0, 20.0, 30.0], name="dxy"), panel(spark, [0.1, 0.2, 0.3], name="y")
    p = C.prediction_frame(f, m, y)
    assert p.columns == ["date", "n", "lag1_dxy", "y", "feature_lag_days"]
    assert [tuple(r)[1:3] for r in p.orderBy("date").collect()] == [(None, None), (1.0, 10.0), (2.0, 20.0)]


def test_horizons(spark):
    t = T.make_targets(panel(spark, [100.0, 101.0, 103.0, 102.0, 105.0]), "price", horizons=(1, 3)).orderBy("date").collect()
    r = [x["y_return"] for x in t]
    assert t[1]["y_return_h3"] == pytest.approx(sum(r[1:4])) and t[1]["y_return_h1"] == pytest.approx(r[1]) and t[3]["y_return_h3"] is None


def test_return_survives_a_holiday(spark):
    p = frame(spark, [(day("2024-01-01"), 100.0, 1.0), (day("2024-01-02"), None, 2.0), (day("2024-01-03"), 110.0, None)], "date date, price double, dxy double")
    t = T.make_targets(p, "price", levels=["dxy"], horizons=()).orderBy("date").collect()
    assert len(t) == 2 and t[1]["y_return"] == pytest.approx(100 * math.log(1.1)) and t[1]["dxy"] == 2.0


def test_today_changes_no_feature_of_today(spark):
    v = [float(x) for x in range(30)]
    a, b = (T.price_features(panel(spark, x, name="y_return")).orderBy("date").collect() for x in (v, [*v[:25], 99.0, *v[26:]]))
    assert a[25] == b[25] and a[26] != b[26] and a[25]["ret_lag1"] == 24.0


def test_splits_and_direction(spark):
    d = frame(spark, [(day(f"2024-01-0{i}"), float(i)) for i in range(1, 7)], "date date, x double")
    s = d.select(N.chronological_split(F.col("date"), "2024-01-02", "2024-01-04").alias("s")).collect()
    assert [r[0] for r in s] == ["train", "train", "val", "val", "test", "test"]
    x = frame(spark, [(0.2,), (-0.2,), (0.05,), (None,)], "x double").select(N.direction(F.col("x"), 0.1)).collect()
    assert [r[0] for r in x] == ["UP", "DOWN", "FLAT", None]


def test_rolling_score_leaves_the_row_out(spark):
    v = [float(i % 5) for i in range(20)] + [100.0]
    z = panel(spark, v).select("date", N.rolling_z(F.col("price"), W.orderBy("date"), 30, 10).alias("z")).orderBy("date").collect()
    base = np.array(v[:20])
    assert z[9]["z"] is None and z[20]["z"] == pytest.approx((100 - base.mean()) / base.std(ddof=1))


def test_decay_is_causal_and_skips_nulls(spark):
    v = [1.0, None, 3.0, 2.0]
    got = [r[0] for r in N.ewm_mean(panel(spark, v), F.col("price"), "m", "date", 2).orderBy("date").select("m").collect()]
    w = [2 ** (i / 2) for i in range(1, 4)]
    assert got[2] == pytest.approx((w[0] * 1 + w[1] * 3) / (w[0] + w[1])) and got[1] == 1.0 and got[3] == pytest.approx((w[0] + 3 * w[1] + 2 * w[2]) / sum(w))


def test_decay_of_a_long_series(spark):
    import pandas as pd

    x = [None if i % 7 == 3 else float(i % 11) for i in range(3000)]
    got = [r[0] for r in N.ewm_mean(frame(spark, list(enumerate(x)), "i long, x double"), F.col("x"), "m", "i", 1.5).orderBy("i").select("m").collect()]
    want = pd.Series(x).ewm(halflife=1.5, ignore_na=True).mean()
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_islands_close_at_the_end(spark):
    p = panel(spark, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]).withColumn("flag", F.col("price") == 0)
    assert sorted(r["length"] for r in N.islands(p, "flag").collect()) == [3, 4]


def text(spark, t, f):
    return one(frame(spark, [(t,)], "t string").select(f(F.col("t"))))


def test_negation_survives(spark):
    assert "not" in text(spark, "Fed will not raise the rates again", X.track_a).split()


def test_track_b_keeps_case_and_strips_outlet(spark):
    assert text(spark, "Fed Holds Rates <b>Again</b> - Reuters", X.track_b) == "Fed Holds Rates Again"


def test_masks_and_aliases(spark):
    assert text(spark, "up 4.5% and $3bn in 2024", X.mask_numbers).split() == ["up", "<PCT>", "and", "<MONEY>", "in", "<NUM>"]
    assert text(spark, "the White  House and U.S. aid to Beijing", X.canonical_names) == "the UNITED_STATES and UNITED_STATES aid to CHINA"
    assert text(spark, "I won't; they can't", X.expand_contractions) == "I will not; they cannot"
    assert text(spark, "cities indexes passing wanted cats as", lambda c: F.array_join(F.transform(X.tokens(c), X.lemma), " ")) == "city index pass want cat as"


def test_unicode_repair(spark):
    assert text(spark, "Fed &amp; ECB ‘hold’ Ａ", X.unicode_repair) == "Fed & ECB 'hold' A"


def test_titles_and_slugs(spark):
    assert text(spark, "<html><title> A &amp; B </title>", X.page_title) == "A &amp; B"
    assert text(spark, "https://x.com/2017/01/03/china-slaps-new-tariffs-on-us-goods.html", X.slug_title) == "china slaps new tariffs on us goods"
    assert text(spark, "https://x.com/a/b-c.html", X.slug_title) is None
    assert text(spark, "https://x.com/short-one-of-4/oil_prices+rise-again-today.cms;v=2?a=b", X.slug_title) == "oil prices rise again today"
    assert text(spark, "https://x.com/élections-à-paris-demain-2024.htm", X.slug_title) == "élections à paris demain"
    assert text(spark, "https://x.com/one-two-three-four.jsp", X.slug_title) is None
    assert text(spark, "HTTP://X.com/a?utm_source=1&id=2#x", X.canonical_url) == "http://x.com/a&id=2"


def record(**own):
    f = {1: "20240115120000", 3: "example.com", 4: "https://x.com/2017/01/03/china-slaps-new-tariffs-on-us-goods.html", 7: "ENV_OILSPILL;TAX_FNCACT", 8: "", 9: "", 15: "1.5,2,3", 26: ""} | {int(k[1:]): v for k, v in own.items()}
    return ("\t".join(f.get(i, "") for i in range(27)),)


def test_records(spark):
    families = {"energy": ["ENV_OIL"], "conflict": ["ARMEDCONFLICT", "MILITARY"]}
    rows = [record(), record(f8="ENV_OIL,120;MILITARY,40", f9="1#a#US#x;1#b#CH#y;1#c#CH#z", f26="x<PAGE_TITLE>Fed &amp; ECB hold rates</PAGE_TITLE>"), record(f7="ENV_OIL"), ("short",)]
    got = S.parse_records(frame(spark, rows, "value string"), families).collect()
    assert [r["families"] for r in got] == [["energy", "conflict"], ["energy"]]
    assert (got[0]["title"], got[0]["title_source"], got[0]["country"], got[0]["tone"]) == ("Fed & ECB hold rates", "page_title", "CH", 1.5)
    assert (got[1]["title"], got[1]["title_source"], got[1]["country"]) == ("china slaps new tariffs on us goods", "url_slug", None)
    assert S.explode_families(S.parse_records(frame(spark, rows, "value string"), families)).count() == 3


def test_country_ties_go_to_the_first(spark):
    assert text(spark, "1#a#US#x;1#b#CH#y", S.primary_country) == "CH"


def test_volume_is_before_the_cap_and_missing_slices_do_not_lower_it(spark):
    rows = frame(spark, [("d", "f", 1.0)] * 10, "day string, theme_family string, tone double")
    ok = frame(spark, [("d", 1), ("d", 2)], "day string, slot int")
    assert one(S.slice_volume(rows, ok).select("volume")) == 5.0 and one(S.slice_volume(rows.limit(5), ok.limit(1)).select("volume")) == 5.0


def test_cap_does_not_depend_on_order(spark):
    a = frame(spark, [("d", "f", i) for i in range(20)], "day string, fam string, id int")
    b = a.orderBy(F.desc("id")).repartition(3)
    got = [sorted(r["id"] for r in S.cap_per_day(x, 3, 42, "day", "fam", "id").collect()) for x in (a, b)]
    assert got[0] == got[1] and len(got[0]) == 3


def test_slots_lie_on_the_grid(spark):
    s = one(spark.range(1).select(D.slot_minutes(5, 20)))
    assert s == sorted(set(s)) and all(x % 15 == 0 and x < 1440 for x in s)


def test_zip_scan(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a\tb\nc\td")
    (tmp_path / "b.zip").write_bytes(b"PK no archive")
    got = S.read_zipped(spark, f"{tmp_path}/*.zip")
    assert sorted(r["value"] for r in got.where("ok").collect()) == ["a\tb", "c\td"]
    name = F.element_at(F.split("path", "/"), -1).alias("path")
    wanted = frame(spark, [("a.zip",), ("b.zip",), ("c.zip",)], "path string")
    states = lambda text: {r["path"]: r["state"] for r in S.slot_states(wanted, got.select(name, "ok", "value"), F.contains("value", F.lit(text))).collect()}
    assert states("c\t") == {"a.zip": "hit", "b.zip": "fail", "c.zip": "missing"} and states("z")["a.zip"] == "miss"


def test_sheet_header_by_content(spark):
    rows = [(0, ["", "", "", None]), (1, ["", "JISDOR", "", None]), (2, ["No", "Tanggal", "Kurs", None]), (3, ["1", "9/1/2026 12:00:00 AM", "17727", None]), (4, ["2", "8/31/2026 12:00:00 AM", "17700", None]), (5, ["3", "bad", "1", None])]
    got = [(r["date"].isoformat(), r["value"]) for r in R.parse_sheet(frame(spark, rows, "row_no long, cells array<string>")).orderBy("date").collect()]
    assert got == [("2026-08-31", 17700.0), ("2026-09-01", 17727.0)]


def test_simhash_of_copies(spark):
    rows = [(1, "fed raises interest rates by a quarter point amid inflation"), (2, "fed raises interest rates by a quarter point amid inflation fear"), (3, "local football team wins the championship game at home"), (4, "")]
    fp = {r["id"]: r["fp"] for r in P.simhash(frame(spark, rows, "id long, t string"), "id", F.col("t")).collect()}
    bits = lambda a, b: ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count()
    assert bits(1, 2) < bits(1, 3) and bits(1, 3) > 6 and fp[4] == 0


def test_dedup_keeps_the_earliest(spark):
    rows = [("b", "Oil prices surge - B News", "http://b/1", "2024-01-01 11:00:00"), ("a", "Oil prices surge", "http://a/1", "2024-01-01 08:00:00"), ("c", "Oil prices surge", "http://c/1", "2024-01-01 14:00:00"), ("d", "Oil prices surge", "http://d/1", "2024-07-01 08:00:00")]
    df = frame(spark, rows, "id string, title string, url string, s string").withColumn("seen", F.col("s").cast("timestamp_ntz"))
    got = {r["id"]: (r["cluster_id"], r["is_duplicate"], r["dup_count"]) for r in P.deduplicate(df, "id", "title", "url", "seen").collect()}
    assert got == {"a": ("a", False, 3), "b": ("a", True, 3), "c": ("a", True, 3), "d": ("d", False, 1)}


def test_gates(spark):
    df = frame(spark, [("www.reuters.com",), ("bbc.com",), ("x.org",), ("spam.blogspot.com",), ("msn.com",), (None,)], "domain string")
    g = G.source_gate(df, {1: ["reuters.com"], 2: ["bbc.com"]}, ["x.org"], ["*.blogspot.*", "msn.com"]).collect()
    assert [r["source_tier"] for r in g] == [1, 2, 3, 3, 3, 3] and [r["is_blocked_domain"] for r in g] == [False, False, False, True, True, False]
    m = frame(spark, [(True, False), (False, False)], "has_a boolean, has_b boolean")
    assert [r["pass_materiality"] for r in G.materiality(m, ["a", "b"]).collect()] == [True, False] and [r["pass_materiality"] for r in G.materiality(m, ["zz"]).collect()] == [True, True]


def test_leakage_report(spark):
    rows = [(day(f"2024-01-{i:02d}"), float(i % 4), float(i % 4) * 2, float(i * i % 7), 1, "train" if i < 8 else "test") for i in range(1, 15)]
    f = frame(spark, rows, "date date, y_return double, leak double, ok double, feature_lag_days int, split string")
    assert [tuple(r) for r in Q.leakage(f, "y_return").collect()] == [("correlates with the target", "leak")]
    assert Q.leakage(f.drop("leak"), "y_return").count() == 0


def test_metrics_and_bootstrap(spark):
    rows = [(i, t, a) for i, (t, a) in enumerate(zip(["UP", "DOWN", "FLAT", "UP"] * 15, ["UP", "FLAT", "FLAT", "DOWN"] * 15, strict=True))]
    df = frame(spark, rows, "i int, y string, p string")
    m = df.agg(*[c.alias(n) for n, c in V.classification(F.col("y"), F.col("p")).items()]).first()
    assert (m["accuracy"], m["coverage"], m["hit_rate"]) == (0.5, 0.5, 0.5)
    r = V.interval(V.bootstrap_gain(df, "y", "p", "p", 10, 20, 1)).first()
    assert (r["low"], r["high"], r["p_no_gain"]) == (0.0, 0.0, 1.0)
    z = frame(spark, [(1.0, 0.0), (-2.0, 0.0)], "y double, p double").agg(V.regression(F.col("y"), F.col("p"))["r2_vs_zero"]).first()[0]
    assert z == 0.0


def test_exact_tests():
    assert V.mcnemar_p(7, 16) == pytest.approx(0.0931, abs=1e-3) and V.mcnemar_p(0, 0) == 1.0
    assert V.spearman_p(0.5, 20) == pytest.approx(0.0248, abs=2e-3)


def test_blend_identity(spark):
    x = frame(spark, [(0.2, 0.3, 0.5, 0.6, 0.3, 0.1)], "a double, b double, c double, d double, e double, f double")
    p, q = [F.col(c) for c in "abc"], [F.col(c) for c in "def"]
    assert list(x.select(*V.late_blend(p, q, F.lit(0.0))).first()) == pytest.approx([0.2, 0.3, 0.5], abs=1e-5)
    assert sum(x.select(*V.late_blend(p, q, F.lit(0.4))).first()) == pytest.approx(1.0)


def test_ridge_is_the_closed_form(spark):
    r = np.random.default_rng(0)
    x, n = r.normal(size=(50, 2)), 50
    y = x @ [1.0, -2.0] + r.normal(size=50) + 3
    df = frame(spark, [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    scaler, model = M.ridge(df, ["a", "b"], "y", 10.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_forecast_uses_earlier_rows_only(spark):
    v = [float(np.sin(i)) for i in range(40)]
    a, b = (M.ar_forecast(panel(spark, x).withColumn("k", F.lit("s")), "k", "date", "price", (1, 2), "2024-01-20").orderBy("date").collect() for x in (v, [*v[:35], 9.0, *v[36:]]))
    assert a[35]["forecast"] == pytest.approx(b[35]["forecast"]) and a[36]["forecast"] != b[36]["forecast"]


def test_vocabulary_from_fitted_rows_only(spark):
    df = frame(spark, [(1, True, ["oil", "war"]), (2, True, ["oil"]), (3, False, ["new", "oil"])], "id int, fit boolean, w array<string>")
    assert {r["term"] for r in M.tfidf(df, "id", F.col("w"), F.col("fit"), 1, 1.0).collect()} == {"oil", "war"}


def test_pooling_and_components(spark):
    df = frame(spark, [(1, [1.0, 0.0], 1.0), (1, [0.0, 1.0], 3.0), (2, [2.0, 2.0], 1.0)], "day int, v array<double>, w double")
    got = {(r["day"], r["pos"]): r["x"] for r in M.pooled(df, F.col("day"), "v", F.col("w")).collect()}
    assert got[1, 0] == 0.25 and got[1, 1] == 0.75 and got[2, 0] == 2.0
    rows = frame(spark, [(i, [float(i), float(i * i % 5), 1.0]) for i in range(10)] + [(99, None)], "id int, v array<double>")
    p = {r["id"]: r["scores"] for r in M.pca(rows.where("id < 8"), rows, "v", 2).collect()}
    assert p[99] is None and np.mean([p[i][0] for i in range(8)]) == pytest.approx(0, abs=1e-9)


def test_samples(spark):
    df = frame(spark, [(i, i % 3) for i in range(60)], "id int, k int")
    s = Z.stratified(df, ["k"], 5, 1, "id")
    assert {r["k"]: r["count"] for r in s.groupBy("k").count().collect()} == {0: 5, 1: 5, 2: 5}
    sheet, key = Z.audit_sheet(df, "id", ["k"], 2, 3, [])
    assert sheet.columns == ["audit_id"] and key.count() == 6


def test_weights(spark):
    df = frame(spark, [(1, 1.0), (3, None), (0, 4.0)], "dup int, v double")
    w = A.syndication_weight(F.col("dup"))
    assert one(df.select(w)) == pytest.approx(math.log(2))
    assert one(df.agg(A.weighted_mean(F.col("v"), w))) == pytest.approx(2.5)


def test_sinks(spark, tmp_path):
    df = frame(spark, [("train", 1), ("test", 2)], "split string, x int")
    R.write_splits(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("split = 'test'").first()["x"] == 2
    assert not R.write_report(df.limit(0), f"{tmp_path}/r") and R.write_report(df, f"{tmp_path}/r")
    assert R.manifest(df, n=F.count("*")) == '{"n": 2}'
    df.write.mode("overwrite").csv(f"{tmp_path}/c", header=True)
    assert R.read_splits(spark, {"a": f"{tmp_path}/c"}, "split string, x int").count() == 2


def test_payloads(spark):
    p = frame(spark, [("f", '{"timeline":[{"data":[{"date":"20240115T000000Z","value":1.5}]}]}')], "theme_family string, payload string")
    assert tuple(S.parse_timeline_payloads(p, "tone").first()) == ("f", day("2024-01-15"), 1.5, "tone")
    a = frame(spark, [('{"articles":[{"url":"u","title":"t"}]}',), ("broken",)], "payload string")
    assert S.parse_article_payloads(a).count() == 1
    assert S.theme_query(["A", "B"], ["eng"]) == "(theme:A OR theme:B) sourcelang:eng"
    with pytest.raises(ValueError):
        S.theme_query([])


def test_complete_days_stream(spark, tmp_path):
    from tidemark.streaming import daily as Y

    rows = [("d1", s, 5) for s in (2, 0, 1)] + [("d1", 0, 5), ("d2", 0, 9)]
    frame(spark, rows, "day string, slot int, n int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("day string, slot int, n int").parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in Y.run_once(Y.complete_days(stream, 3), f"{tmp_path}/out").select("day", "volume").collect()]
    assert got == [("d1", 5.0)]


def test_first_copies_stream(spark, tmp_path):
    from tidemark.streaming import daily as Y

    frame(spark, [("Oil up", "2024-01-01 08:00:00"), ("Oil up", "2024-01-01 09:00:00"), ("Gas", "2024-01-01 09:00:00")], "title string, s string").select("title", F.col("s").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("title string, ts timestamp").parquet(f"{tmp_path}/in")
    assert Y.run_once(Y.first_copies(stream), f"{tmp_path}/out").count() == 2


def test_near_copies_stream(spark, tmp_path):
    from tidemark.streaming import daily as Y

    a, b = "fed raises interest rates by a quarter point amid inflation", "local football team wins the championship after a long season"
    batches = [[(1, 0, a), (2, 3600, b)], [(3, 7200, a + "."), (4, 10**6, a)]]
    out = f"{tmp_path}/out"
    for n, rows in enumerate(batches):
        frame(spark, rows, "id long, t long, title string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, t long, title string").parquet(f"{tmp_path}/in")
        got = Y.run_once(stream, out, step=Y.near_copies(out))
    assert {r["id"]: r["root"] for r in got.collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_build_of_synthetic_inputs(spark):
    from tidemark.plans.dataset import Config, build
    from tidemark.sources import synthetic as Y

    days = Y.weekdays(spark, "2024-01-01", "2024-06-28")
    config = Config(train_end="2024-04-30", val_end="2024-05-31")
    frame, marked, problems = build(Y.articles(days), Y.fx_panel(days), config)
    frame = frame.cache()
    assert problems.count() == 0 and frame.count() == days.count()
    assert marked.where("is_duplicate").count() > 0 and marked.where("keep AND is_duplicate").count() == 0
    # yesterday's news moves today: the planted shock shows at the lag and not without it
    now = frame.select("date", "y_abs", "n_articles", F.lead("n_articles").over(C.by_date()).alias("same_day"))
    lagged, same = now.select(F.corr("y_abs", "n_articles"), F.corr("y_abs", "same_day")).first()
    assert lagged > 0.6 > 0.3 > abs(same)
    assert Y.timelines(days).count() == 3 * days.count()


def test_pooling_modes(spark):
    from tidemark.operators import vectors as O

    df = frame(spark, [(d, i, [float(i), 1.0], float(1 + i)) for d in (1, 2) for i in range(3)], "day int, i int, v array<double>, w double")
    get = lambda **k: {(r["day"], r["pos"]): r["x"] for r in O.daily_vectors(df, "day", "v", F.col("w"), **k).collect()}
    assert get()[1, 0] == pytest.approx(8 / 6) and get(mode="attention")[1, 0] == pytest.approx(1.0) and get(mode="decay")[2, 1] == pytest.approx(1.0)
    s = O.sequences(df.where("i < 2"), "day", "v", [F.desc("w")], F.col("w"), 3, 2).first()
    assert s["mask"] == [1, 1, 0] and s["items"][2] == [0.0, 0.0] and s["prior"][2] == -1e9 and s["items"][0][0] == 1.0
    with pytest.raises(ValueError):
        O.daily_vectors(df, "day", "v", F.col("w"), "x")


def test_drift_and_importance(spark):
    from tidemark.operators import vectors as O

    df = frame(spark, [(i, float(i), float(i * 7 % 11), float(i) * 2 + i * 7 % 11) for i in range(80)], "id int, a double, b double, y double")
    assert O.drift_auc(df, ["a"], F.col("id") < 40, "id", 3) > 0.95
    scaler, model = M.ridge(df, ["a", "b"], "y", 0.1)
    assert O.importance(["a", "b"], model)[0][0] == "a"
    t = frame(spark, [(0, "x", 0.5), (0, "y", -0.5), (0, "z", 0.1)], "component int, term string, loading double")
    assert sorted((r["side"], r["term"]) for r in O.top_terms(t, 1).collect()) == [("high", "x"), ("low", "y")]
