"""Window and target queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import targets as T
from ..operators import windows as N
from ..operators.calendar import by_date
from .base import ART, CTL, PX, RET, articles, controls, prices, query, r6, table


def returns(spark, d):
    return prices(spark, d).withColumn("ret", N.log_return(F.col("price"), by_date()))


_Z = """CASE WHEN count({x}) OVER w >= 10 THEN ({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0) END"""


@query(f"WITH {PX} SELECT date, round({_Z.format(x='price')}, 6) AS z FROM px WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def rolling_z30(spark, d):
    return prices(spark, d).select("date", r6(N.rolling_z(F.col("price"), by_date(), 30), "z"))


@query(f"WITH {PX} SELECT date, round({_Z.format(x='n')}, 6) AS z FROM px WINDOW w AS (ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)")
def rolling_z90(spark, d):
    return prices(spark, d).select("date", r6(N.rolling_z(F.col("n"), by_date(), 90), "z"))


@query(f"WITH {RET} SELECT date, {', '.join(f'round(lag(ret, {k}) OVER (ORDER BY date), 6) AS ret_lag{k}' for k in range(1, 6))} FROM rt")
def return_lags(spark, d):
    return returns(spark, d).select("date", *[r6(F.lag("ret", k).over(by_date()), f"ret_lag{k}") for k in range(1, 6)])


@query(f"""WITH {RET} SELECT date, {', '.join(f'round(CASE WHEN count(ret) OVER w{k} = {k} THEN avg(ret) OVER w{k} END, 6) AS mom{k}, round(CASE WHEN count(ret) OVER w{k} = {k} THEN stddev_samp(ret) OVER w{k} END, 6) AS vol{k}' for k in (5, 20))},
 round(abs(lag(ret) OVER (ORDER BY date)), 6) AS abs_last FROM rt WINDOW w5 AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def momentum_vol(spark, d):
    return T.price_features(returns(spark, d), "ret", lags=0)


@query(f"WITH {RET} SELECT date, round(ret, 6) AS ret, round(price - lag(price) OVER (ORDER BY date), 2) AS diff FROM rt")
def log_returns(spark, d):
    return returns(spark, d).select("date", r6("ret", "ret"), r6(F.col("price") - F.lag("price").over(by_date()), "diff", 2))


@query(f"""WITH {PX}, {CTL}, a AS (SELECT coalesce(px.date, ctl.date) AS date, price, level FROM px FULL JOIN ctl USING (date)),
 f AS (SELECT date, price, last_value(level IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS level FROM a) SELECT date, level FROM f WHERE price IS NOT NULL""")
def ffill_controls(spark, d):
    """Controls carried forward over all dates, then cut to the days on which the target prints."""
    a = prices(spark, d).join(controls(spark, d), "date", "full").withColumn("level", N.forward_fill(F.col("level"), by_date()))
    return a.where("price IS NOT NULL").select("date", "level")


@query(f"WITH {RET} SELECT date, round(CASE WHEN count(ret) OVER w = 5 THEN stddev_samp(ret) OVER w END, 6) AS vol FROM rt WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def realized_vol5(spark, d):
    return returns(spark, d).select("date", r6(N.trailing(F.stddev_samp, F.col("ret"), by_date(), 5, include=True), "vol"))


@query(f"""WITH {RET}, h AS (SELECT date, CASE WHEN count(ret) OVER w = 3 THEN sum(ret) OVER w END AS h3 FROM rt WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
 SELECT date, round(h3, 6) AS y_h3, CASE WHEN h3 > 10 * sqrt(3) THEN 'UP' WHEN h3 < -10 * sqrt(3) THEN 'DOWN' WHEN h3 IS NOT NULL THEN 'FLAT' END AS y_direction_h3 FROM h""")
def horizon_targets(spark, d):
    h = returns(spark, d).withColumn("h3", N.horizon_sum(F.col("ret"), by_date(), 3))
    return h.select("date", r6("h3", "y_h3"), N.direction(F.col("h3"), 10 * 3**0.5).alias("y_direction_h3"))


@query(f"""WITH {PX}, f AS (SELECT date, n = 1 AS flag FROM px), s AS (SELECT date, flag, CASE WHEN flag AND NOT coalesce(lag(flag) OVER (ORDER BY date), false) THEN 1 ELSE 0 END AS fresh FROM f),
 i AS (SELECT date, flag, sum(fresh) OVER (ORDER BY date) AS island FROM s), g AS (SELECT min(date) AS "start", max(date) AS "end" FROM i WHERE flag GROUP BY island)
 SELECT "start", "end", CAST(date_diff('day', "start", "end") + 1 AS INTEGER) AS length FROM g WHERE date_diff('day', "start", "end") + 1 >= 3""")
def zero_runs(spark, d):
    """Runs of days with a single print."""
    return N.islands(prices(spark, d).withColumn("flag", F.col("n") == 1), "flag")


@query(f"WITH {ART}, k AS (SELECT local_date, article_id, dup_count, row_number() OVER (PARTITION BY local_date ORDER BY dup_count DESC, article_id) AS rank FROM art) SELECT local_date, article_id, dup_count, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def topk_per_day(spark, d):
    return N.top_k(articles(spark, d), "local_date", 5, F.desc("dup_count"), F.asc("article_id")).select("local_date", "article_id", "dup_count", "rank")


@query(f"""WITH {RET}, k AS (SELECT date, CASE WHEN n >= 2 THEN ret END AS x FROM rt), i AS (SELECT *, count(x) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS i FROM k)
 SELECT date, round(sum(x * pow(2, i / 5.0)) OVER w / sum(CASE WHEN x IS NOT NULL THEN pow(2, i / 5.0) END) OVER w, 6) AS ewm FROM i WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def ewm_halflife(spark, d):
    r = returns(spark, d).withColumn("x", F.when(F.col("n") >= 2, F.col("ret")))
    return N.ewm_mean(r, F.col("x"), "ewm", "date", 5).select("date", r6("ewm", "ewm"))


@query(f"""WITH {ART}, e AS (SELECT article_id, local_date, exp(dup_count - max(dup_count) OVER (PARTITION BY local_date)) AS e FROM art)
 SELECT article_id, round(e / sum(e) OVER (PARTITION BY local_date), 8) AS weight FROM e""")
def day_softmax(spark, d):
    return articles(spark, d).select("article_id", r6(N.softmax(F.col("dup_count").cast("double"), W.partitionBy("local_date")), "weight", 8))


@query(f"WITH {RET}, l AS (SELECT ret, lag(ret) OVER (ORDER BY date) AS p FROM rt) SELECT round(corr(ret, p), 6) AS r1, round(corr(abs(ret), abs(p)), 6) AS r1_abs FROM l")
def autocorr(spark, d):
    r = returns(spark, d).withColumn("p", F.lag("ret").over(by_date()))
    return r.agg(r6(F.corr("ret", "p"), "r1"), r6(F.corr(F.abs("ret"), F.abs("p")), "r1_abs"))


@query(f"WITH {PX} SELECT date, CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split FROM px")
def chrono_split(spark, d):
    return prices(spark, d).select("date", N.chronological_split(F.col("date"), "1998-06-30", "1999-12-31").alias("split"))


@query(f"""WITH {PX}, {CTL}, a AS (SELECT coalesce(px.date, ctl.date) AS date, price, level FROM px FULL JOIN ctl USING (date)),
 f AS (SELECT date, price, last_value(level IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS level FROM a),
 t AS (SELECT * FROM f WHERE price IS NOT NULL), r AS (SELECT date, 100 * (ln(price) - ln(lag(price) OVER (ORDER BY date))) AS y, 100 * (ln(level) - ln(lag(level) OVER (ORDER BY date))) AS c FROM t)
 SELECT date, round(y, 6) AS y_return, round(abs(y), 6) AS y_abs, round(CASE WHEN count(y) OVER w = 5 THEN stddev_samp(y) OVER w END, 6) AS y_vol,
 CASE WHEN y > 10 THEN 'UP' WHEN y < -10 THEN 'DOWN' WHEN y IS NOT NULL THEN 'FLAT' END AS y_direction, round(c, 6) AS ret_level
 FROM r WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def targets(spark, d):
    panel = prices(spark, d).select("date", "price").join(controls(spark, d), "date", "full")
    t = T.make_targets(panel, "price", returns=["level"], band=10, horizons=())
    return t.select("date", r6("y_return", "y_return"), r6("y_abs", "y_abs"), r6("y_vol", "y_vol"), "y_direction", r6("ret_level", "ret_level"))


@query(f"""WITH {RET}, q AS (SELECT date, CASE WHEN count(ret) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 5 THEN avg(ret) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS m FROM rt) SELECT date, round(m, 6) AS display_mean FROM q""")
def display_mean(spark, d):
    return returns(spark, d).select("date", r6(N.trailing(F.avg, F.col("ret"), by_date(), 20, include=True, least=5), "display_mean"))


@query("SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_date, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, CAST(year(ts) AS INTEGER) AS year, CAST((hour(ts) * 60 + minute(ts)) // 15 * 15 AS INTEGER) AS slot FROM events")
def date_parts(spark, d):
    """Zone date, re-formatted stamp, year and 15-minute slot of each event."""
    from ..functions import dates as D

    e = table(spark, d, "events")
    return e.select("event_id", D.epoch_local_date(D.epoch(F.col("ts")), "Asia/Jakarta").alias("local_date"), D.stamp(F.col("ts")).alias("stamp"), F.year("ts").alias("year"), D.slot_of(F.col("ts"), 15).alias("slot"))
