"""Evaluation, statistics, leakage and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import quality as Q
from ..operators import windows as N
from ..operators.calendar import by_date
from .base import RET, query, r6, table
from .windows import returns

#: Days with a true direction and two predictions: yesterday's, and the sign of the number of prints.
PRED = RET + """, pr AS (SELECT date, ret, n, price, CASE WHEN ret > 10 THEN 'UP' WHEN ret < -10 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'FLAT' END AS truth, lag(ret) OVER (ORDER BY date) AS p FROM rt),
 pd AS (SELECT date, ret, n, price, truth, CASE WHEN p > 10 THEN 'UP' WHEN p < -10 THEN 'DOWN' ELSE 'FLAT' END AS a, CASE WHEN n >= 3 THEN 'UP' WHEN n = 2 THEN 'FLAT' ELSE 'DOWN' END AS b, p, 10.0 * (n - 2) AS pn,
 CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split FROM pr WHERE ret IS NOT NULL AND p IS NOT NULL)"""


def predictions(spark, d):
    x = returns(spark, d).select("date", "ret", "n", "price", N.direction(F.col("ret"), 10).alias("truth"), F.lag("ret").over(by_date()).alias("p")).where("ret IS NOT NULL AND p IS NOT NULL")
    return x.withColumns({
        "a": N.direction(F.col("p"), 10), "b": F.when(F.col("n") >= 3, "UP").when(F.col("n") == 2, "FLAT").otherwise("DOWN"), "pn": 10.0 * (F.col("n") - 2),
        "split": N.chronological_split(F.col("date"), "1998-06-30", "1999-12-31"),
    })


def _f1(c, p="a", t="truth"):
    return f"coalesce(2.0 * count(*) FILTER (WHERE {t} = '{c}' AND {p} = '{c}') / nullif(count(*) FILTER (WHERE {t} = '{c}') + count(*) FILTER (WHERE {p} = '{c}'), 0), 0)"


def _macro(p="a", t="truth"):
    return "(" + " + ".join(_f1(c, p, t) for c in V.CLASSES) + ") / 3"


@query(f"""WITH {PRED} SELECT split, round({_macro()}, 6) AS macro_f1, round(avg((truth = a)::INT), 6) AS accuracy, round(count(*) FILTER (WHERE a <> 'FLAT' AND a = truth) * 1.0 / nullif(count(*) FILTER (WHERE a <> 'FLAT'), 0), 6) AS hit_rate,
 round(avg((a <> 'FLAT')::INT), 6) AS coverage, {', '.join(f'round({_f1(c)}, 6) AS "f1_{c}"' for c in V.CLASSES)} FROM pd GROUP BY 1""")
def cls_metrics(spark, d):
    m = V.classification(F.col("truth"), F.col("a"))
    return predictions(spark, d).groupBy("split").agg(*[r6(c, n) for n, c in m.items()])


@query(f"""WITH {PRED} SELECT split, round(sqrt(avg((ret - pn) * (ret - pn))), 6) AS rmse, round(avg(abs(ret - pn)), 6) AS mae, round(count(*) FILTER (WHERE ret <> 0 AND sign(ret) = sign(pn)) * 1.0 / nullif(count(*) FILTER (WHERE ret <> 0), 0), 6) AS directional,
 round(1 - sum((ret - pn) * (ret - pn)) / nullif(sum(ret * ret), 0), 6) AS r2_vs_zero FROM pd GROUP BY 1""")
def reg_metrics(spark, d):
    m = V.regression(F.col("ret"), F.col("pn"))
    return predictions(spark, d).groupBy("split").agg(*[r6(c, n) for n, c in m.items()])


@query(f"""WITH {PRED}, c AS (SELECT * FROM (VALUES ('DOWN'), ('FLAT'), ('UP')) x("true"), (VALUES ('DOWN'), ('FLAT'), ('UP')) y(pred)) SELECT "true", pred, count(truth) AS n FROM c LEFT JOIN pd ON truth = "true" AND a = pred GROUP BY 1, 2""")
def confusion(spark, d):
    return V.confusion(predictions(spark, d), "truth", "a")


@query(f"""WITH {PRED}, t AS (SELECT truth, a, b, row_number() OVER (ORDER BY date) - 1 AS i FROM pd), m AS (SELECT count(*) AS n, CAST(ceil(count(*) / 10.0) AS BIGINT) AS each FROM t),
 dr AS (SELECT id // each AS rep, id % each AS k, n FROM (SELECT unnest(generate_series(0, 1000 * each - 1)) AS id, each, n FROM m)),
 st AS (SELECT rep, k, n, ('0x' || substr(md5('42|' || rep || '|' || k), 1, 12))::BIGINT % greatest(n - 9, 1) AS start FROM dr),
 rw AS (SELECT rep, start + o AS i FROM st, generate_series(0, 9) g(o) WHERE k * 10 + o < n), s AS (SELECT rep, {_macro('b')} - {_macro('a')} AS gain FROM rw JOIN t USING (i) GROUP BY rep)
 SELECT round(avg(gain), 6) AS mean, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, round(avg((gain <= 0)::INT), 6) AS p_no_gain FROM s""")
def bootstrap_gain(spark, d):
    """Gain of one prediction over another on 1,000 resamples of all days, in blocks of 10."""
    t = predictions(spark, d).withColumn("i", F.row_number().over(by_date()) - 1)
    return V.interval(V.bootstrap_gain(t, "truth", "a", "b")).select(*[r6(c, c) for c in ("mean", "low", "high", "p_no_gain")])


@query(f"""WITH {PRED}, r AS (SELECT 'm' AS model, split, {_macro('a')} AS ma, {_macro('b')} AS mb FROM pd GROUP BY 2) SELECT model, split, round(ma, 6) AS base, round(mb, 6) AS other, round(mb - ma, 6) AS gain FROM r""")
def gain_table(spark, d):
    p = predictions(spark, d)
    one = lambda name: p.groupBy("split").agg(V.macro_f1(F.col("truth"), F.col(name)).alias("macro_f1")).select(F.lit("m").alias("model"), "split", F.lit(name).alias("features"), "macro_f1")
    return V.news_gain(one("a").union(one("b")), "a", "b").select("model", "split", *[r6(c, c) for c in ("base", "other", "gain")])


_RANK = "(rank() OVER (PARTITION BY split ORDER BY {x}) + (count(*) OVER (PARTITION BY split, {x}) - 1) / 2.0)"


@query(f"WITH {PRED}, k AS (SELECT split, {_RANK.format(x='n')} AS rn, {_RANK.format(x='ret')} AS rr FROM pd) SELECT split, round(corr(rn, rr), 6) AS rho, count(*) AS rows FROM k GROUP BY 1")
def spearman(spark, d):
    k = V.ranked(predictions(spark, d).select("split", "n", "ret"), "n", "ret", group=["split"])
    return k.groupBy("split").agg(r6(F.corr("n", "ret"), "rho"), F.count("*").alias("rows"))


@query(f"WITH {PRED} SELECT split, count(*) FILTER (WHERE a = truth AND b = truth) AS both_right, count(*) FILTER (WHERE a = truth AND b <> truth) AS only_a, count(*) FILTER (WHERE a <> truth AND b = truth) AS only_b, count(*) FILTER (WHERE a <> 'FLAT' AND truth = 'FLAT') AS false_signals FROM pd GROUP BY 1")
def mcnemar_counts(spark, d):
    a, b = F.col("a") == F.col("truth"), F.col("b") == F.col("truth")
    return predictions(spark, d).groupBy("split").agg(F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if((F.col("a") != "FLAT") & (F.col("truth") == "FLAT")).alias("false_signals"))


@query(f"""WITH {PRED}, e AS (SELECT quantile_cont(price, 1.0 / 3) AS e1, quantile_cont(price, 2.0 / 3) AS e2 FROM pd), g AS (SELECT CASE WHEN price <= e1 THEN 'low' WHEN price <= e2 THEN 'mid' ELSE 'high' END AS tercile, truth, a FROM pd, e) SELECT tercile, count(*) AS n, round(avg((a <> truth)::INT), 6) AS error FROM g GROUP BY 1""")
def tercile_error(spark, d):
    t = V.terciles(predictions(spark, d).select("price", "truth", "a"), "price")
    return t.groupBy("tercile").agg(F.count("*").alias("n"), r6(F.avg((F.col("a") != F.col("truth")).cast("int")), "error"))


_P = "0.2 + (event_id % 7) / 20.0 AS p1, 0.1 + (event_id % 5) / 20.0 AS p2, 0.15 + (event_id % 11) / 40.0 AS q1, 0.3 + (event_id % 3) / 20.0 AS q2"
PROB = f"pq AS (SELECT event_id, event_type, p1, p2, 1 - p1 - p2 AS p3, q1, q2, 1 - q1 - q2 AS q3 FROM (SELECT event_id, event_type, {_P} FROM events))"


def probabilities(spark, d):
    i = F.col("event_id")
    own = table(spark, d, "events").select("event_id", "event_type", (0.2 + (i % 7) / 20.0).alias("p1"), (0.1 + (i % 5) / 20.0).alias("p2"), (0.15 + (i % 11) / 40.0).alias("q1"), (0.3 + (i % 3) / 20.0).alias("q2"))
    return own.withColumns({"p3": 1 - F.col("p1") - F.col("p2"), "q3": 1 - F.col("q1") - F.col("q2")})


def _vec(x):
    return [F.col(f"{x}{k}") for k in (1, 2, 3)]


@query(f"WITH {PROB} SELECT event_id, round(0.5 * (abs(p1 - q1) + abs(p2 - q2) + abs(p3 - q3)), 6) AS tv FROM pq ORDER BY tv DESC, event_id LIMIT 20")
def tv_shift(spark, d):
    return probabilities(spark, d).select("event_id", r6(V.total_variation(_vec("p"), _vec("q")), "tv")).orderBy(F.desc("tv"), "event_id").limit(20)


_BL = "exp(0.5 * ln({p} + 1e-6) + 0.5 * ln({q} + 1e-6))"


@query(f"""WITH {PROB}, e AS (SELECT event_id, p1, {', '.join(f"{_BL.format(p=f'p{k}', q=f'q{k}')} AS e{k}" for k in (1, 2, 3))} FROM pq)
 SELECT event_id, round(e1 / (e1 + e2 + e3), 6) AS b_down, round(e2 / (e1 + e2 + e3), 6) AS b_flat, round(e3 / (e1 + e2 + e3), 6) AS b_up, round(p1, 4) AS w0_down FROM e""")
def late_blend(spark, d):
    x = probabilities(spark, d)
    b, z = V.late_blend(_vec("p"), _vec("q"), F.lit(0.5)), V.late_blend(_vec("p"), _vec("q"), F.lit(0.0))
    return x.select("event_id", r6(b[0], "b_down"), r6(b[1], "b_flat"), r6(b[2], "b_up"), r6(z[0], "w0_down", 4))


@query(f"WITH {PROB}, a AS (SELECT event_id, CASE WHEN round(p1, 4) >= round(p2, 4) AND round(p1, 4) >= round(p3, 4) THEN 'DOWN' WHEN round(p2, 4) >= round(p3, 4) THEN 'FLAT' ELSE 'UP' END AS label FROM pq) SELECT event_id, label FROM a")
def argmax_label(spark, d):
    return probabilities(spark, d).select("event_id", V.argmax_label([F.round(c, 4) for c in _vec("p")]).alias("label"))


@query(f"""WITH {PROB}, w(w) AS (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)), l AS (SELECT w, event_type, (1 - w) * ln(p1 + 1e-6) + w * ln(q1 + 1e-6) AS l1, (1 - w) * ln(p2 + 1e-6) + w * ln(q2 + 1e-6) AS l2, (1 - w) * ln(p3 + 1e-6) + w * ln(q3 + 1e-6) AS l3 FROM pq, w),
 c AS (SELECT w, round(avg((round(l1, 9) >= round(l3, 9) AND round(l1, 9) >= round(l2, 9))::INT), 6) AS score FROM l WHERE event_type = 'click' GROUP BY 1) SELECT CAST(w AS DOUBLE) AS weight, score FROM c ORDER BY score DESC, w LIMIT 1""")
def blend_weight(spark, d):
    """The blend weight with the best score, the smaller of equals."""
    w = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("weight")
    x = probabilities(spark, d).where("event_type = 'click'").select("*", w)
    logs = [(1 - F.col("weight")) * F.ln(p + 1e-6) + F.col("weight") * F.ln(q + 1e-6) for p, q in zip(_vec("p"), _vec("q"), strict=True)]
    top = [F.round(x, 9) for x in logs]
    s = x.groupBy("weight").agg(r6(F.avg(((top[0] >= top[1]) & (top[0] >= top[2])).cast("int")), "score"))
    return s.orderBy(F.desc("score"), "weight").limit(1)


@query(f"""WITH {PRED}, c AS (SELECT corr(n, ret) AS n, corr(price, ret) AS price, corr(p, ret) AS p, corr(pn, ret) AS pn FROM pd) SELECT "column", round(value, 6) AS r FROM (UNPIVOT c ON COLUMNS(*) INTO NAME "column" VALUE value)""")
def corr_screen(spark, d):
    from ..operators.aggregates import unpivot

    return unpivot(predictions(spark, d).agg(*[F.corr(c, "ret").alias(c) for c in ("n", "price", "p", "pn")]), "column", "value").select("column", r6("value", "r"))


@query(f"""WITH {PRED}, f AS (SELECT date, ret AS y_return, n, 2 * ret + 1 AS leak, 0 AS feature_lag_days, split FROM pd), d AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE date IN (SELECT min(date) FROM f)),
 c AS (SELECT corr(n, y_return) AS n, corr(leak, y_return) AS leak FROM d)
 SELECT 'lag below one row' AS problem, '0' AS detail UNION ALL SELECT 'repeated dates', CAST(count(*) - count(DISTINCT date) AS VARCHAR) FROM d UNION ALL SELECT 'correlates with the target', 'leak' FROM c WHERE abs(leak) > 0.95""")
def leakage_checks(spark, d):
    """A frame with planted faults: no lag, a repeated date, a column made of the target."""
    f = predictions(spark, d).select("date", F.col("ret").alias("y_return"), "n", (2 * F.col("ret") + 1).alias("leak"), F.lit(0).alias("feature_lag_days"), "split")
    return Q.leakage(f.union(f.orderBy("date").limit(1)), "y_return")


@query("""WITH x AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS po FROM x), m AS (SELECT c, (SELECT count(*) FROM x WHERE a = c) AS na, (SELECT count(*) FROM x WHERE b = c) AS nb FROM (SELECT DISTINCT a AS c FROM x UNION SELECT DISTINCT b FROM x))
 SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM t, (SELECT sum(na * nb) / (SELECT n * n FROM t) AS pe FROM m)""")
def kappa(spark, d):
    return V.kappa(table(spark, d, "labels"), "quality", "toxic").select(r6("kappa", "kappa"))


@query("SELECT d.source, count(*) AS n, round(avg((quality = 1)::INT), 6) AS \"precision\", round(avg((quality = 1 AND toxic = 0)::INT), 6) AS clean, round(count(*) FILTER (WHERE quality = 0 AND toxic = 1) * 1.0 / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS miss_rate FROM labels JOIN documents d USING (doc_id) GROUP BY 1")
def audit_scores(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return x.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg((q == 1).cast("int")), "precision"), r6(F.avg(((q == 1) & (t == 0)).cast("int")), "clean"), r6(F.try_divide(F.count_if((q == 0) & (t == 1)), F.count_if(t == 1)), "miss_rate"))


@query(f"WITH {PRED}, s AS (SELECT (split = 'train')::INT AS y, round(price, 2) AS x FROM pd), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def drift_auc(spark, d):
    """How well one column tells training from later days."""
    s = predictions(spark, d).select((F.col("split") == "train").cast("int").alias("y"), F.round("price", 2).alias("x"))
    return V.rank_auc(s, "y", "x").select(r6("auc", "auc"))


@query(f"WITH {PRED}, k AS (SELECT split, date, abs(ret) AS size, truth, a, row_number() OVER (PARTITION BY split ORDER BY abs(ret) DESC, date) AS r FROM pd WHERE a <> truth) SELECT split, date, round(size, 6) AS size, truth, a FROM k WHERE r <= 5")
def error_examples(spark, d):
    e = predictions(spark, d).where("a <> truth").withColumn("size", F.abs("ret"))
    return N.top_k(e, "split", 5, F.desc("size"), F.asc("date")).select("split", "date", r6("size", "size"), "truth", "a")


@query("SELECT o_orderstatus AS model, o_orderkey AS params, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_params(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("params"), F.col("o_totalprice").alias("score"))
    return V.best_per_group(o, "model", "score", F.asc("params"))


@query("SELECT o_orderkey AS params, o_totalprice AS score FROM orders WHERE o_orderpriority NOT LIKE '%LOW%' AND NOT starts_with(o_orderpriority, '1') ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def candidate_filter(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority NOT LIKE '%LOW%' AND NOT startswith(o_orderpriority, '1')")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select(F.col("o_orderkey").alias("params"), F.col("o_totalprice").alias("score"))


@query(f"WITH {PRED}, m AS (SELECT truth FROM pd WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, truth LIMIT 1) SELECT date, (SELECT truth FROM m) AS majority, a AS persistence, 0.0::DOUBLE AS zero FROM pd")
def baselines(spark, d):
    from ..operators.models import majority

    p = predictions(spark, d)
    return p.crossJoin(F.broadcast(majority(p.where("split = 'train'"), "truth"))).select("date", "majority", F.col("a").alias("persistence"), F.lit(0.0).alias("zero"))


@query("SELECT vec_id % 30 AS day, arg_max(vec_id, struct_pack(s := label * 7 % 5, v := -vec_id)) AS top FROM embeddings GROUP BY 1")
def most_attended(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy((F.col("vec_id") % 30).alias("day")).agg(F.max_by("vec_id", F.struct((F.col("label") * 7 % 5).alias("s"), (-F.col("vec_id")).alias("v"))).alias("top"))
