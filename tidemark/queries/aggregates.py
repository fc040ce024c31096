"""Aggregation and quality-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import quality as Q
from ..operators import windows as N
from ..operators.calendar import by_date
from ..sources import articles as S
from .base import ART, BUCKET, PX, RET, articles, bucketed, prices, query, r6, table
from .gates import GATED, gated
from .windows import returns



@query(f"""WITH {BUCKET}, w AS (SELECT td, coalesce(date_diff('day', td, lead(td) OVER (ORDER BY td)) * 24, 24) AS h FROM cal)
 SELECT news_day AS date, count(*) AS n_articles, count(DISTINCT country) AS n_countries, round(ln(1 + count(*)), 6) AS log_n_articles, round(count(*) * 24.0 / greatest(any_value(h), 1), 6) AS n_per_24h FROM bk JOIN w ON td = news_day GROUP BY 1""")
def daily_volume(spark, d):
    from ..operators.calendar import attach_news_day
    from .base import weekdays

    arts = articles(spark, d)
    g = attach_news_day(arts, weekdays(arts)).groupBy(F.col("news_day").alias("date"))
    return g.agg(F.count("*").alias("n_articles"), F.count_distinct("country").alias("n_countries"), r6(F.log1p(F.count("*")), "log_n_articles"), r6(F.count("*") * 24 / F.greatest(F.any_value("window_hours"), F.lit(1.0)), "n_per_24h"))


@query(f"WITH {ART} SELECT local_date, round(avg(dup_count), 6) AS mean, max(dup_count) AS max, round(quantile_cont(dup_count, 0.9), 6) AS p90 FROM art GROUP BY 1")
def syndication_stats(spark, d):
    return articles(spark, d).groupBy("local_date").agg(r6(F.avg("dup_count"), "mean"), F.max("dup_count").alias("max"), r6(F.percentile("dup_count", 0.9), "p90"))


@query(f"WITH {ART} SELECT local_date, round(avg((tier = 0)::INT), 6) AS tier_0, round(avg((tier = 1)::INT), 6) AS tier_1, round(avg((tier = 9)::INT), 6) AS tier_9, round(avg((country IN ('C01', 'C02'))::INT), 6) AS state_share FROM art GROUP BY 1")
def tier_shares(spark, d):
    arts = articles(spark, d)
    wide = A.shares_wide(arts, "local_date", "tier", [0, 1, 9], "tier_")
    state = arts.groupBy("local_date").agg(r6(A.share(F.col("country").isin("C01", "C02")), "state_share"))
    return wide.select("local_date", *[r6(c, c) for c in ("tier_0", "tier_1", "tier_9")]).join(state, "local_date")


@query(f"""WITH {ART} SELECT local_date, {', '.join(f"count(*) FILTER (WHERE theme_family = '{t}') AS n_{t}, round(count(*) FILTER (WHERE theme_family = '{t}') * 1.0 / nullif(count(*), 0), 6) AS share_{t}" for t in ('view', 'click', 'none'))} FROM art GROUP BY 1""")
def theme_shares(spark, d):
    g = articles(spark, d).groupBy("local_date")
    own = [F.col("theme_family") == t for t in ("view", "click", "none")]
    return g.agg(*[c for o, t in zip(own, ("view", "click", "none"), strict=True) for c in (F.count_if(o).alias(f"n_{t}"), r6(F.count_if(o) / F.count("*"), f"share_{t}"))])


@query(f"""WITH {ART}, p AS (SELECT local_date, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY local_date) AS s FROM art GROUP BY local_date, theme_family) SELECT local_date, round(-sum(s * ln(s)), 6) AS entropy FROM p GROUP BY 1""")
def theme_entropy(spark, d):
    n = articles(spark, d).groupBy("local_date", "theme_family").agg(F.count("*").alias("n"))
    return n.groupBy("local_date").agg(r6(A.entropy(F.col("n")), "entropy"))


@query(f"""WITH {ART}, p AS (SELECT local_date, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY local_date) AS s FROM art GROUP BY local_date, country) SELECT local_date, round(sum(s * s), 6) AS hhi, count(*) AS n_countries FROM p GROUP BY 1""")
def geo_hhi(spark, d):
    n = articles(spark, d).where("country IS NOT NULL").groupBy("local_date", "country").agg(F.count("*").alias("n"))
    return n.groupBy("local_date").agg(r6(A.herfindahl(F.col("n").cast("double")), "hhi"), F.count("*").alias("n_countries"))


@query("SELECT host, round(avg(len(string_split(t, ' '))), 6) AS mean_title_words FROM (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \t]+', ' ', 'g')) AS t FROM pages) WHERE t <> '' GROUP BY 1")
def headline_length(spark, d):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", X.PAGE_TITLE, 1), "[ \t]+", " "))
    t = table(spark, d, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("host"), title.alias("t")).where("t <> ''")
    return t.groupBy("host").agg(r6(F.avg(F.size(F.split("t", " "))), "mean_title_words"))


@query(f"WITH {ART} SELECT local_date, round(sum(tone * ln(1 + dup_count)) / sum(CASE WHEN tone IS NOT NULL THEN ln(1 + dup_count) END), 6) AS tone, round(sum(tone * dup_count) / sum(CASE WHEN tone IS NOT NULL THEN dup_count END), 6) AS tone_linear FROM art GROUP BY 1")
def weighted_mean(spark, d):
    return articles(spark, d).groupBy("local_date").agg(r6(A.weighted_mean(F.col("tone"), A.syndication_weight(F.col("dup_count"))), "tone"), r6(A.weighted_mean(F.col("tone"), F.col("dup_count")), "tone_linear"))


@query("SELECT o_orderpriority, round(sum(ln(1 + o_orderkey % 5) * (o_custkey % 7)) / nullif(sum(ln(1 + o_orderkey % 5) * (o_custkey % 11)), 0), 6) AS ratio FROM orders GROUP BY 1")
def weighted_ratio(spark, d):
    o = table(spark, d, "orders")
    w = F.log1p((F.col("o_orderkey") % 5).cast("double"))
    return o.groupBy("o_orderpriority").agg(r6(A.weighted_ratio(F.col("o_custkey") % 7, F.col("o_custkey") % 11, w), "ratio"))


@query(f"""WITH {ART}, s AS (SELECT local_date, avg(tone) AS mean, stddev_samp(tone) AS std, avg((tone < 50)::INT) AS neg_share, avg((tone > 100)::INT) AS pos_share, count(tone) AS n FROM art GROUP BY 1),
 f AS (SELECT local_date, avg(tone) FILTER (WHERE theme_family = 'view') AS view, avg(tone) FILTER (WHERE theme_family = 'click') AS click FROM art GROUP BY 1)
 SELECT local_date, round(mean, 6) AS mean, round(std, 6) AS std, round(neg_share, 6) AS neg_share, round(pos_share, 6) AS pos_share, n, round((pos_share - neg_share) / nullif(pos_share + neg_share, 0), 6) AS net_tone, round(view, 6) AS tone_view, round(click, 6) AS tone_click FROM s JOIN f USING (local_date)""")
def sentiment_daily(spark, d):
    t, own = F.col("tone"), lambda f: F.avg(F.when(F.col("theme_family") == f, F.col("tone")))
    s = articles(spark, d).groupBy("local_date").agg(F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.avg((t < 50).cast("int")).alias("neg"), F.avg((t > 100).cast("int")).alias("pos"), F.count(t).alias("n"), own("view").alias("v"), own("click").alias("c"))
    return s.select("local_date", r6("mean", "mean"), r6("std", "std"), r6("neg", "neg_share"), r6("pos", "pos_share"), "n", r6(F.try_divide(F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg")), "net_tone"), r6("v", "tone_view"), r6("c", "tone_click"))


@query(f"""WITH {ART}, k AS (SELECT local_date AS day, CAST(hour(seen_utc) AS INTEGER) AS slot, theme_family, tone FROM art), ok AS (SELECT day, count(DISTINCT slot) AS ok FROM k GROUP BY 1)
 SELECT day, theme_family, round(count(*) * 1.0 / any_value(ok), 6) AS volume, round(avg(tone), 6) AS tone FROM k JOIN ok USING (day) GROUP BY 1, 2""")
def slice_volume(spark, d):
    k = articles(spark, d).select(F.col("local_date").alias("day"), F.hour("seen_utc").alias("slot"), "theme_family", "tone")
    return S.slice_volume(k, k.select("day", "slot").distinct()).select("day", "theme_family", r6("volume", "volume"), r6("tone", "tone"))


@query(f"""WITH {ART}, c AS (SELECT theme_family, country, count(*) AS n FROM art GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme_family ORDER BY n DESC, country) AS r FROM c) SELECT theme_family, country, n FROM r WHERE r = 1""")
def modal_value(spark, d):
    return A.most_frequent(articles(spark, d), "theme_family", "country")


@query(f"WITH {ART} SELECT local_date AS date, round(avg(tone) FILTER (WHERE theme_family = 'view'), 6) AS gdelt_tone_view, round(avg(tone) FILTER (WHERE theme_family = 'click'), 6) AS gdelt_tone_click FROM art GROUP BY 1")
def timeline_wide(spark, d):
    w = A.timeline_wide(articles(spark, d).withColumnRenamed("local_date", "date"), ["view", "click"], "tone", "tone")
    return w.select("date", *[r6(c, c) for c in w.columns[1:]])


@query(f"""WITH {PX}, n AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
 SELECT CAST(year(px.date) AS INTEGER) AS year, count(*) AS trading_days, count(k) AS days_with_news, round(100.0 * count(k) / count(*), 6) AS pct, median(coalesce(k, 0)) AS median_articles FROM px LEFT JOIN n USING (date) GROUP BY 1""")
def coverage_by_year(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n_articles"))
    c = Q.coverage_by_year(prices(spark, d).select("date"), n)
    return c.withColumn("pct", F.round("pct", 6))


@query(f"""WITH {ART}, g AS (SELECT local_date, theme_family, count(*) AS n FROM art GROUP BY 1, 2) SELECT theme_family, round(100.0 * avg((n >= 80)::INT), 6) AS pct_at_cap, median(n) AS median, max(n) AS max FROM g GROUP BY 1""")
def cap_saturation(spark, d):
    c = Q.cap_saturation(articles(spark, d), "local_date", "theme_family", 80)
    return c.withColumn("pct_at_cap", F.round("pct_at_cap", 6))


@query(f"""WITH {PX}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, median(price) AS median, avg(price) AS mean, stddev_samp(price) AS std, count(*) AS n FROM px GROUP BY 1)
 SELECT year, round(median, 4) AS median, round(mean, 4) AS mean, round(std, 4) AS std, n, round(median / lag(median) OVER (ORDER BY year), 6) AS yoy FROM y""")
def structural_break(spark, d):
    b = Q.structural_break(prices(spark, d), "price")
    return b.select("year", *[r6(c, c, 4) for c in ("median", "mean", "std")], "n", r6("yoy", "yoy"))


@query(f"""WITH {RET}, l AS (SELECT ret, lag(ret) OVER (ORDER BY date) AS p FROM rt), s AS (SELECT count(ret)::DOUBLE AS n, avg(ret) AS mean, stddev_samp(ret) AS std, skewness(ret) AS skew, kurtosis(ret) AS kurtosis, min(ret) AS min, max(ret) AS max, corr(ret, p) AS autocorr1,
 avg((ret > 10)::INT) AS up, avg((ret < -10)::INT) AS down FROM l) SELECT metric, round(value, 4) AS value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)""")
def target_stats(spark, d):
    return Q.target_stats(returns(spark, d), "ret", 10).select("metric", r6("value", "value", 4))


@query(f"""WITH {RET}, s AS (SELECT avg(ret) AS m, stddev_samp(ret) AS sd FROM rt), c AS (SELECT count(*) FILTER (WHERE ret = 0) AS zero, count(*) FILTER (WHERE abs(ret - m) > 3 * sd) AS far, count(*) FILTER (WHERE abs(ret) > 100) AS large FROM rt, s)
 SELECT 'exact zero returns' AS "check", zero AS n, CASE WHEN zero = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM c UNION ALL SELECT 'beyond 3 deviations', far, CASE WHEN far = 0 THEN 'PASS' ELSE 'REVIEW' END FROM c UNION ALL SELECT 'large moves', large, CASE WHEN large = 0 THEN 'PASS' ELSE 'REVIEW' END FROM c""")
def sanity_checks(spark, d):
    return Q.sanity_checks(returns(spark, d), "ret", deviations=3, large=100)


@query(f"""WITH {GATED}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE keep) AS k, count(DISTINCT doc_id) AS u, count(*) FILTER (WHERE trim(title) = '') AS b FROM fu)
 SELECT rule, ok FROM (SELECT 'rows' AS rule, n > 0 AS ok FROM c UNION ALL SELECT 'some kept', k > 0 FROM c UNION ALL SELECT 'ids unique', u = n FROM c UNION ALL SELECT 'blank titles under 1 %', b < 0.01 * n FROM c)""")
def validity_summary(spark, d):
    g = gated(spark, d)
    return Q.rules(g, {"rows": F.count("*") > 0, "some kept": F.count_if("keep") > 0, "ids unique": F.count_distinct("doc_id") == F.count("*"), "blank titles under 1 %": F.count_if(F.trim("title") == "") < 0.01 * F.count("*")})


@query(f"""WITH {RET}, a AS (SELECT n, ret, lag(ret, 5) OVER (ORDER BY date) AS ret_lag5, CASE WHEN n > 2 THEN price END AS busy FROM rt), m AS (SELECT avg((n IS NULL)::INT) AS n, avg((ret IS NULL)::INT) AS ret, avg((ret_lag5 IS NULL)::INT) AS ret_lag5, avg((busy IS NULL)::INT) AS busy FROM a)
 SELECT "column", round(missing, 6) AS missing FROM (UNPIVOT m ON COLUMNS(*) INTO NAME "column" VALUE missing) ORDER BY missing DESC, "column" LIMIT 3""")
def missingness(spark, d):
    a = returns(spark, d).select("n", "ret", F.lag("ret", 5).over(by_date()).alias("ret_lag5"), F.when(F.col("n") > 2, F.col("price")).alias("busy"))
    return Q.missingness(a, 3).withColumn("missing", F.round("missing", 6))


@query(f"""WITH {RET}, a AS (SELECT n, ret, price FROM rt), s AS (SELECT 'n' AS "column", count(n) AS non_null, avg(n) AS mean, stddev_samp(n) AS std FROM a UNION ALL SELECT 'ret', count(ret), avg(ret), stddev_samp(ret) FROM a UNION ALL SELECT 'price', count(price), avg(price), stddev_samp(price) FROM a)
 SELECT "column", CASE WHEN starts_with("column", 'r') THEN 'return' WHEN starts_with("column", 'p') THEN 'price' ELSE 'other' END AS "group", non_null, round(mean, 3) AS mean, round(std, 3) AS std FROM s""")
def feature_dictionary(spark, d):
    f = Q.feature_dictionary(returns(spark, d).select("n", "ret", "price"), [("r", "return"), ("p", "price"), ("re", "never")])
    return f.select("column", "group", "non_null", r6("mean", "mean", 3), r6("std", "std", 3))


@query(f"""WITH {RET}, y AS (SELECT CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split, CASE WHEN ret > 10 THEN 'UP' WHEN ret < -10 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'FLAT' END AS c FROM rt)
 SELECT split, round(avg((c = 'DOWN')::INT), 6) AS "DOWN", round(avg((c = 'FLAT')::INT), 6) AS "FLAT", round(avg((c = 'UP')::INT), 6) AS "UP" FROM y WHERE c IS NOT NULL GROUP BY 1""")
def class_balance(spark, d):
    y = returns(spark, d).select(N.chronological_split(F.col("date"), "1998-06-30", "1999-12-31").alias("split"), N.direction(F.col("ret"), 10).alias("c")).where("c IS NOT NULL")
    w = A.shares_wide(y, "split", "c", ["DOWN", "FLAT", "UP"], "")
    return w.select("split", *[r6(c, c) for c in ("DOWN", "FLAT", "UP")])


@query(f"""WITH {ART} SELECT local_date, {', '.join(f"round(coalesce(sum(CASE WHEN {c} THEN ln(1 + dup_count) END), 0) / sum(ln(1 + dup_count)), 6) AS share_{n}, round(sum(CASE WHEN {c} THEN tone * ln(1 + dup_count) END) / sum(CASE WHEN {c} AND tone IS NOT NULL THEN ln(1 + dup_count) END), 6) AS tone_{n}" for n, c in (('low', "country < 'C10'"), ('none', "country = 'XX'")))} FROM art GROUP BY 1""")
def entity_block(spark, d):
    """Share (0 where absent) and tone (null where absent) of each watched group."""
    return Q.entity_block(articles(spark, d), "local_date", {"low": F.col("country") < "C10", "none": F.col("country") == "XX"}).select("local_date", *[r6(c, c) for c in ("share_low", "tone_low", "share_none", "tone_none")])


@query("""WITH b AS (SELECT event_id % 30 AS day, user_id % 3 AS topic, value FROM events) SELECT day, round(avg((topic = 0)::INT), 6) AS share_0, round(avg((topic = 1)::INT), 6) AS share_1, round(avg((topic = 5)::INT), 6) AS share_5, round(avg(value) FILTER (WHERE topic = 0), 6) AS tone_0, avg(value) FILTER (WHERE topic = 5) AS tone_5 FROM b GROUP BY 1""")
def topic_block(spark, d):
    b = table(spark, d, "events").select((F.col("event_id") % 30).alias("day"), (F.col("user_id") % 3).alias("topic"), "value")
    own = lambda k: F.avg(F.when(F.col("topic") == k, F.col("value")))
    s = A.shares_wide(b, "day", "topic", [0, 1, 5]).select("day", *[r6(f"share_{k}", f"share_{k}") for k in (0, 1, 5)])
    return s.join(b.groupBy("day").agg(r6(own(0), "tone_0"), own(5).alias("tone_5")), "day")


@query("""WITH p AS (SELECT event_id % 30 AS day, 1 + event_id % 4 AS dup, 0.2 + (event_id % 7) / 20.0 AS pos, 0.1 + (event_id % 5) / 20.0 AS neg FROM events), q AS (SELECT *, 1 - pos - neg AS neu FROM p)
 SELECT day, round(sum(pos * ln(1 + dup)) / sum(ln(1 + dup)), 6) AS pos, round(sum((pos - neg) * ln(1 + dup)) / sum(ln(1 + dup)), 6) AS tone, round(avg((neg > pos AND neg > neu)::INT), 6) AS neg_argmax_share, round(stddev_samp(pos - neg), 6) AS tone_std FROM q GROUP BY 1""")
def transformer_tone(spark, d):
    i = F.col("event_id")
    q = table(spark, d, "events").select((i % 30).alias("day"), (1 + i % 4).alias("dup"), (0.2 + (i % 7) / 20.0).alias("pos"), (0.1 + (i % 5) / 20.0).alias("neg")).withColumn("neu", 1 - F.col("pos") - F.col("neg"))
    w = A.syndication_weight(F.col("dup"))
    worst = (F.col("neg") > F.col("pos")) & (F.col("neg") > F.col("neu"))
    return q.groupBy("day").agg(r6(A.weighted_mean(F.col("pos"), w), "pos"), r6(A.weighted_mean(F.col("pos") - F.col("neg"), w), "tone"), r6(A.share(worst), "neg_argmax_share"), r6(F.stddev_samp(F.col("pos") - F.col("neg")), "tone_std"))


@query("SELECT o_orderstatus AS split, o_orderpriority AS model, o_custkey % 3 AS seed_group, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max FROM orders GROUP BY 1, 2, 3")
def seed_summary(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 3).alias("seed_group"))
    return g.agg(r6(F.avg("o_totalprice"), "mean", 4), r6(F.stddev_samp("o_totalprice"), "std", 4), r6(F.min("o_totalprice"), "min", 2), r6(F.max("o_totalprice"), "max", 2))


@query("SELECT o_orderpriority AS model, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def result_pivot(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return p.select("model", *[r6(c, c, 4) for c in "FOP"])


@query(f"""WITH {PX}, o AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS high, max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1) SELECT px.date, price AS truth, high, low FROM px LEFT JOIN o USING (date)""")
def prediction_table(spark, d):
    """One column a model, beside the truth, by date."""
    w = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).pivot("o_orderpriority", ["2-HIGH", "5-LOW"]).agg(F.max("o_totalprice"))
    return prices(spark, d).select("date", F.col("price").alias("truth")).join(w.select("date", F.col("`2-HIGH`").alias("high"), F.col("`5-LOW`").alias("low")), "date", "left")


@query(f"WITH {ART}, s AS (SELECT article_id, theme_family FROM art WHERE tier = 1 UNION ALL SELECT article_id, theme_family FROM art WHERE country < 'C05') SELECT theme_family, count(*) AS n, count(DISTINCT article_id) AS kinds FROM s GROUP BY 1")
def union_families(spark, d):
    arts = articles(spark, d)
    s = arts.where("tier = 1").select("article_id", "theme_family").unionByName(arts.where("country < 'C05'").select("theme_family", "article_id"))
    return s.groupBy("theme_family").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("kinds"))


@query("SELECT label FROM (SELECT quality AS label FROM labels UNION SELECT toxic FROM labels)")
def label_categories(spark, d):
    x = table(spark, d, "labels")
    return x.select(F.col("quality").alias("label")).union(x.select("toxic")).distinct()


@query(f"""WITH {ART}, a AS (SELECT avg((tone IS NOT NULL)::INT) AS any_hit, avg((tone > 100)::INT) AS pos, avg((tone < 20)::INT) AS neg FROM art) SELECT metric, round(value, 6) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value)""")
def lexicon_coverage(spark, d):
    t = F.col("tone")
    return A.unpivot(articles(spark, d).agg(A.share(t.isNotNull()).alias("any_hit"), A.share(t > 100).alias("pos"), A.share(t < 20).alias("neg"))).select("metric", r6("value", "value"))
