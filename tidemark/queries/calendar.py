"""Calendar and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import windows as N
from .base import BUCKET, CAL, CTL, PX, RET, articles, bucketed, controls, prices, query, r6, table, weekdays


@query(f"""WITH {BUCKET}, f AS (SELECT news_day AS date, count(*) AS n_articles FROM bk WHERE news_day IS NOT NULL GROUP BY 1),
 p AS (SELECT news_day, theme_family, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY news_day) AS s FROM bk WHERE news_day IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT news_day AS date, -sum(s * ln(s)) AS entropy FROM p GROUP BY 1),
 v AS (SELECT news_day AS date, sum(tone) / count(tone) AS level FROM bk WHERE news_day IS NOT NULL GROUP BY 1),
 a AS (SELECT f.date, n_articles, entropy, 100 * (ln(level) - ln(lag(level) OVER (ORDER BY f.date))) AS y_return,
  CASE WHEN count(n_articles) OVER w >= 3 THEN (n_articles - avg(n_articles) OVER w) / nullif(stddev_samp(n_articles) OVER w, 0) END AS z
  FROM f JOIN h USING (date) JOIN v USING (date) WINDOW w AS (ORDER BY f.date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
 SELECT date, lag(n_articles) OVER (ORDER BY date) AS n_articles, round(lag(entropy) OVER (ORDER BY date), 6) AS entropy,
  round(lag(z) OVER (ORDER BY date), 6) AS volume_z, round(y_return, 4) AS y_return,
  CASE WHEN y_return > 0.1 THEN 'UP' WHEN y_return < -0.1 THEN 'DOWN' WHEN y_return IS NOT NULL THEN 'FLAT' END AS y_direction FROM a""")
def daily_panel_direction(spark, d):
    """Events to local dates, to trading buckets, to lagged features beside the day's direction."""
    from ..plans.daily import direction_panel

    return direction_panel(bucketed(spark, d).where("news_day IS NOT NULL"))


@query(f"WITH {BUCKET} SELECT article_id, local_date, news_day FROM bk")
def asof_floor_bucket(spark, d):
    return bucketed(spark, d).select("article_id", "local_date", "news_day")


@query(f"""WITH {CAL} SELECT td, coalesce(date_diff('day', td, lead(td) OVER (ORDER BY td)) * 24, 24)::DOUBLE AS window_hours,
 coalesce(date_diff('day', td, lead(td) OVER (ORDER BY td)) * 24, 24) > 30 AS is_post_weekend FROM cal""")
def bucket_window_hours(spark, d):
    return C.buckets(weekdays(articles(spark, d)))


@query(f"""WITH {BUCKET}, w AS (SELECT td, coalesce(date_diff('day', td, lead(td) OVER (ORDER BY td)) * 24, 24)::DOUBLE AS h FROM cal)
 SELECT news_day, count(*) AS n, any_value(h) AS window_hours, round(count(*) * 24 / greatest(any_value(h), 1), 6) AS n_per_day, bool_or(h > 30) AS is_post_weekend
 FROM bk JOIN w ON bk.news_day = w.td GROUP BY 1""")
def attach_news_day(spark, d):
    arts = articles(spark, d)
    b = C.attach_news_day(arts, weekdays(arts)).groupBy("news_day")
    return b.agg(F.count("*").alias("n"), F.first("window_hours").alias("window_hours"), r6(F.count("*") * 24 / F.greatest(F.first("window_hours"), F.lit(1.0)), "n_per_day"), F.bool_or("is_post_weekend").alias("is_post_weekend"))


@query(f"WITH {PX} SELECT date AS td FROM px WHERE price IS NOT NULL")
def calendar_from_series(spark, d):
    return C.trading_calendar(prices(spark, d), "price")


@query(f"""WITH {RET}, {CTL}, f AS (SELECT date, lag(n) OVER (ORDER BY date) AS n FROM px), m AS (SELECT date, lag(level) OVER (ORDER BY date) AS lag1_level FROM ctl)
 SELECT rt.date, f.n, lag1_level, round(rt.ret, 6) AS y_return, 1 AS feature_lag_days FROM f FULL JOIN m USING (date) JOIN rt ON rt.date = coalesce(f.date, m.date)""")
def prediction_frame(spark, d):
    p = prices(spark, d)
    labels = p.select("date", r6(N.log_return(F.col("price"), C.by_date()), "y_return"))
    return C.prediction_frame(p.select("date", "n"), controls(spark, d), labels).select("date", "n", "lag1_level", "y_return", "feature_lag_days")


@query(f"""WITH {PX}, {CTL}, a AS (SELECT px.date, lag(level) OVER (ORDER BY px.date) AS level FROM px LEFT JOIN ctl USING (date))
 SELECT date, level FROM a WHERE date IN (SELECT date FROM px WHERE n >= 2)""")
def lag_to_rows(spark, d):
    p = prices(spark, d)
    return C.lag_to_rows(controls(spark, d), ["level"], C.trading_calendar(p, "price"), p.where("n >= 2"))


@query(f"""WITH {RET}, y AS (SELECT date, ret, CASE WHEN ret > 10 THEN 'UP' WHEN ret < -10 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'FLAT' END AS y_direction FROM rt)
 SELECT date, y_direction, lag(y_direction) OVER (ORDER BY date) AS persist_direction FROM y""")
def assemble_persistence(spark, d):
    y = prices(spark, d).select("date", N.direction(N.log_return(F.col("price"), C.by_date()), 10).alias("y_direction"))
    return y.withColumn("persist_direction", F.lag("y_direction").over(C.by_date()))


@query(f"""WITH {PX}, {CTL}, c AS (SELECT DISTINCT date FROM ctl) SELECT c.date, coalesce(n, 0) AS n, price FROM c LEFT JOIN px USING (date)""")
def reindex_fill(spark, d):
    return C.reindex(prices(spark, d).select("date", "n", "price"), controls(spark, d).select(F.col("date").alias("td")), ["n"])


@query(f"WITH {RET} SELECT date, round(lead(ret) OVER (ORDER BY date), 6) AS next_return, round(lead(abs(ret)) OVER (ORDER BY date), 6) AS next_volatility FROM rt")
def next_label(spark, d):
    p = prices(spark, d).withColumn("ret", N.log_return(F.col("price"), C.by_date()))
    return p.select("date", r6(F.lead("ret").over(C.by_date()), "next_return"), r6(F.lead(F.abs("ret")).over(C.by_date()), "next_volatility"))


@query(f"""WITH {PX}, {CTL} SELECT coalesce(px.date, ctl.date) AS date, price, level FROM px FULL JOIN ctl USING (date)
 WHERE coalesce(px.date, ctl.date) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def outer_panel(spark, d):
    return C.outer_panel({"price": prices(spark, d).withColumnRenamed("price", "value"), "level": controls(spark, d).withColumnRenamed("level", "value")}, "1996-01-01", "2000-12-31")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_remaining(spark, d):
    """Work that no finished part covers."""
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""SELECT count(*) = 0 AS same FROM ((SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem)
 UNION ALL (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders))""")
def cache_valid(spark, d):
    """Whether two key columns hold the same rows."""
    a = table(spark, d, "orders").select("o_orderkey")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return a.exceptAll(b).union(b.exceptAll(a)).agg((F.count("*") == 0).alias("same"))


@query(f"""WITH {BUCKET}, t AS (SELECT local_date AS date, avg(tone) AS tone, count(*) AS matches FROM art GROUP BY 1)
 SELECT td AS date, matches, round(tone, 6) AS tone FROM cal LEFT JOIN t ON cal.td = t.date""")
def timeline_join(spark, d):
    arts = articles(spark, d)
    t = arts.groupBy(F.col("local_date").alias("date")).agg(F.count("*").alias("matches"), r6(F.avg("tone"), "tone"))
    return weekdays(arts).select(F.col("td").alias("date")).join(t, "date", "left")


@query("SELECT l.doc_id, l.quality, l.toxic, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def audit_key_join(spark, d):
    key = table(spark, d, "documents").select("doc_id", "source")
    return table(spark, d, "labels").dropna(subset=["quality", "toxic"]).join(key, "doc_id").select("doc_id", "quality", "toxic", "source")


@query(f"""WITH {RET}, s AS (SELECT date, ret, lag(ret) OVER (ORDER BY date) AS shifted FROM rt), l AS (SELECT a.date, b.ret AS direct FROM
 (SELECT date, row_number() OVER (ORDER BY date) AS i FROM rt) a LEFT JOIN (SELECT ret, row_number() OVER (ORDER BY date) AS i FROM rt) b ON b.i = a.i - 1)
 SELECT count(*) AS rows_checked, count(*) FILTER (WHERE shifted IS DISTINCT FROM direct) AS mismatches FROM s JOIN l USING (date)""")
def lag_guard(spark, d):
    """Row t must hold the value of row t - 1: a shift against a join by row number."""
    p = prices(spark, d).withColumn("ret", N.log_return(F.col("price"), C.by_date())).withColumn("i", F.row_number().over(C.by_date()))
    shifted = C.lag_rows(p, ["ret"])
    direct = p.select("date", "i").join(p.select((F.col("i") + 1).alias("i"), F.col("ret").alias("direct")), "i", "left").drop("i")
    return shifted.join(direct, "date").agg(F.count("*").alias("rows_checked"), F.count_if(~F.col("ret").eqNullSafe(F.col("direct"))).alias("mismatches"))
