"""Queries of landed files and payloads, requests and sinks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import sampling as M
from ..operators import targets as P
from ..operators import vectors as V
from ..operators import windows as N
from ..operators.calendar import attach_news_day
from ..plans import dataset as B
from ..sources import articles as S
from ..sources import series as R
from ..sources import synthetic as Y
from .base import ART, BUCKET, RET, articles, query, r6, scratch, table, weekdays
from .windows import returns


@F.pandas_udf(T.BinaryType())
def _zipped(text: pd.Series) -> pd.Series:
    def one(t: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x.csv", t)
        return out.getvalue()

    return text.map(one)


def archives(spark, d):
    """One archive a user's events: event_id and type, a line each."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.concat_ws("\t", "event_id", "event_type").alias("line"))
    return e.groupBy("path").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("text")).select("path", _zipped("text").alias("content"))


@query("SELECT 'u' || user_id AS path, event_id || chr(9) || event_type AS value FROM events")
def zip_scan(spark, d):
    return S.unzipped(archives(spark, d)).where("ok").select("path", "value")


@query("""WITH f AS (SELECT 'u' || user_id AS path, bool_or(event_type = 'purchase') AS hit FROM events GROUP BY 1), w AS (SELECT 'u' || unnest(generate_series(0, (SELECT max(user_id) + 5 FROM events))) AS path)
 SELECT path, CASE WHEN hit IS NULL THEN 'missing' WHEN hit THEN 'hit' ELSE 'miss' END AS state FROM w LEFT JOIN f USING (path)""")
def slot_states(spark, d):
    """What became of each wanted archive: users who bought, who did not, and numbers that no user has."""
    wanted = table(spark, d, "events").agg((F.max("user_id") + 5).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i")).select(F.concat(F.lit("u"), "i").alias("path"))
    return S.slot_states(wanted, S.unzipped(archives(spark, d)), F.contains("value", F.lit("purchase")))


_FAMILIES = {"conflict": ("ARMEDCONFLICT", "MILITARY"), "energy": ("ENV_OIL",)}


@query("""WITH f(theme_family, query) AS (VALUES ('conflict', '(theme:ARMEDCONFLICT OR theme:MILITARY) (sourcelang:english OR sourcelang:german)'), ('energy', 'theme:ENV_OIL (sourcelang:english OR sourcelang:german)')),
 g AS (SELECT CAST(d AS DATE) AS query_day, theme_family, query, CAST(c AS INTEGER) AS chunk FROM generate_series(DATE '2024-01-03', DATE '2024-02-24', INTERVAL 3 DAY) x(d), f, generate_series(0, 3) y(c))
 SELECT *, CAST(query_day AS TIMESTAMP) + to_hours(chunk * 6) AS window_start, CAST(query_day AS TIMESTAMP) + to_hours(chunk * 6 + 6) AS window_end FROM g""")
def census_grid(spark, d):
    return S.census(spark, "2024-01-01", "2024-02-24", _FAMILIES, ("english", "german"), 3, 4, "2024-01-03")


@query("SELECT 'conflict' AS theme_family, '(theme:ARMEDCONFLICT OR theme:MILITARY) sourcelang:english' AS query UNION ALL SELECT 'energy', 'theme:ENV_OIL sourcelang:english'")
def theme_search(spark, d):
    return spark.createDataFrame([(f, S.theme_query(t, ["english"])) for f, t in _FAMILIES.items()], "theme_family string, query string")


@query("SELECT user_id, event_id::VARCHAR AS url, event_type AS title, strftime(ts, '%Y%m%dT%H%M%SZ') AS seendate, 'english' AS language, CAST(NULL AS VARCHAR) AS domain, 'C' || user_id AS sourcecountry FROM events")
def article_payloads(spark, d):
    """Articles of one payload a user, without a domain."""
    one = F.struct(F.col("event_id").cast("string").alias("url"), F.col("event_type").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.lit("english").alias("language"), F.concat(F.lit("C"), "user_id").alias("sourcecountry"))
    landed = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(one).alias("articles"))).alias("payload"))
    return S.parse_article_payloads(landed).select("user_id", "url", "title", "seendate", "language", "domain", "sourcecountry")


@query("SELECT event_type AS theme_family, CAST(ts AS DATE) AS date, count(*)::DOUBLE AS value, 'volume' AS metric FROM events GROUP BY 1, 2")
def timeline_payloads(spark, d):
    daily = table(spark, d, "events").groupBy(F.col("event_type").alias("theme_family"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))
    point = F.struct(F.date_format("day", "yyyyMMdd'T000000Z'").alias("date"), "value")
    landed = daily.groupBy("theme_family").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(point).alias("data"))).alias("timeline"))).alias("payload"))
    return S.parse_timeline_payloads(landed, "volume")


@query("""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' +'), lambda t: t <> '')) AS word FROM conversations)
 SELECT word, 'vowel' AS category FROM w WHERE left(word, 1) IN ('a', 'e', 'i', 'o', 'u') UNION ALL SELECT word, 'long' FROM w WHERE length(word) > 6""")
def lexicon_members(spark, d):
    """A lexicon file, written with flags a category and read as memberships."""
    words = table(spark, d, "conversations").select(F.explode(X.tokens(F.lower(F.regexp_replace("text", "[^a-zA-Z]+", " ")))).alias("word")).distinct()
    path = scratch(spark, "lexicon")
    words.select("word", F.substring("word", 1, 1).isin(*"aeiou").cast("int").alias("vowel"), (F.length("word") > 6).cast("int").alias("long")).write.csv(path, header=True)
    return S.read_lexicon(spark, path, ["vowel", "long"])


@query(f"WITH {ART} SELECT article_id, theme_family, tier FROM art")
def dataset_sink(spark, d):
    """A table written with its manifest and read back."""
    path = scratch(spark, "dataset")
    R.write_dataset(articles(spark, d).select("article_id", "theme_family", "tier"), path, rows=F.count("*"))
    return R.read_dataset(spark, path)


@query(f"WITH {ART} SELECT theme_family, count(*)::VARCHAR AS n FROM art GROUP BY 1")
def report_sink(spark, d):
    path = scratch(spark, "report")
    R.write_report(articles(spark, d).groupBy("theme_family").agg(F.count("*").alias("n")), path)
    return spark.read.csv(path, header=True)


@query(f"""WITH {ART} SELECT '{{"families": ' || count(DISTINCT theme_family) || ', "first": "' || min(local_date) || '", "rows": ' || count(*) || '}}' AS manifest FROM art""")
def manifest_row(spark, d):
    text = R.manifest(articles(spark, d), rows=F.count("*"), families=F.count_distinct("theme_family"), first=F.min("local_date"))
    return spark.createDataFrame([(text,)], "manifest string")


@query(f"WITH {RET} SELECT date, round(ret, 6) AS ret, CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split FROM rt")
def split_sink(spark, d):
    """Splits written to a folder each and read back."""
    path = scratch(spark, "splits")
    R.write_splits(returns(spark, d).select("date", r6("ret", "ret"), N.chronological_split(F.col("date"), "1998-06-30", "1999-12-31").alias("split")), path)
    return spark.read.parquet(path).select("date", "ret", F.col("split").cast("string").alias("split"))


@query(f"""WITH {BUCKET}, w AS (SELECT td, coalesce(date_diff('day', td, lead(td) OVER (ORDER BY td)) * 24, 24)::DOUBLE AS h FROM cal), k AS (SELECT bk.*, h FROM bk JOIN w ON news_day = td),
 p AS (SELECT news_day, theme_family, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY news_day) AS s FROM k GROUP BY 1, 2), e AS (SELECT news_day, -sum(s * ln(s)) AS entropy FROM p GROUP BY 1)
 SELECT news_day AS date, count(*) AS n_articles, round(count(*) * 24 / greatest(any_value(h), 1), 6) AS n_per_24h, round(avg(dup_count), 6) AS dup_mean, max(dup_count) AS dup_max, round(quantile_cont(dup_count, 0.9), 6) AS dup_p90,
 count(DISTINCT country) AS n_countries, round(avg((tone > 100)::INT), 6) AS share_market_term, count(*) FILTER (WHERE theme_family = 'click') AS n_click, round(avg((tier = 1)::INT), 6) AS share_tier1,
 round(any_value(entropy), 6) AS theme_entropy FROM k JOIN e USING (news_day) GROUP BY 1""")
def daily_features(spark, d):
    """The driver of the daily block: volume, syndication, tiers, families, their entropy and countries of a bucket."""
    arts = articles(spark, d)
    kept = attach_news_day(arts, weekdays(arts)).where("news_day IS NOT NULL").withColumns({"sourcecountry": F.col("country"), "source_tier": F.col("tier"), "has_market_term": F.col("tone") > 100})
    f = B.daily_features(kept, B.Config(families=("click", "error", "purchase", "signup", "view")))
    plain = ["date", "n_articles", "dup_max", "n_countries", "n_click"]
    return f.select(*plain, *[r6(c, c) for c in ("n_per_24h", "dup_mean", "dup_p90", "share_market_term", "share_tier1", "theme_entropy")])


def _past(f: str, n: int) -> str:
    frame = f"OVER (ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(ret) {frame} = {n} THEN {f}(ret) {frame} END"


@query(f"""WITH {RET} SELECT date, {', '.join(f'round(lag(ret, {k}) OVER (ORDER BY date), 6) AS ret_lag{k}' for k in range(1, 6))}, {', '.join(f'round({_past("avg", w)}, 6) AS mom{w}, round({_past("stddev_samp", w)}, 6) AS vol{w}' for w in (5, 20))},
 round(abs(lag(ret) OVER (ORDER BY date)), 6) AS abs_last FROM rt""")
def price_features(spark, d):
    return P.price_features(returns(spark, d), "ret")


@query(f"""WITH {ART}, r AS (SELECT article_id, theme_family, dup_count, row_number() OVER (PARTITION BY theme_family ORDER BY md5('5|' || article_id::VARCHAR), article_id) AS r FROM art)
 SELECT row_number() OVER (ORDER BY md5('6|' || article_id::VARCHAR), article_id)::INTEGER AS audit_id, dup_count, article_id, theme_family FROM r WHERE r <= 12""")
def audit_sheet(spark, d):
    """A blind sheet of 12 articles a family, joined with its key again."""
    sheet, key = M.audit_sheet(articles(spark, d), "article_id", ["theme_family"], 12, 5, ["dup_count"])
    return sheet.join(key, "audit_id")


@query()
def unicode_repair(spark, d):
    """Entities, compatibility forms and typographic marks of page titles; no SQL resolves entities."""
    return table(spark, d, "pages").select("page_id", X.unicode_repair(F.regexp_extract("html", X.PAGE_TITLE, 1)).alias("title"))


@query("""WITH k AS (SELECT vec_id % 30 AS day, embedding AS v, ln(2 + label) AS w, row_number() OVER (PARTITION BY vec_id % 30 ORDER BY label DESC, vec_id) AS r FROM embeddings),
 g AS (SELECT day, count(*) AS n, list(CAST(v[1] AS DOUBLE) ORDER BY r) AS items, list(w ORDER BY r) AS prior FROM k WHERE r <= 20 GROUP BY 1)
 SELECT day, list_sum(items) AS _s, least(n, 20)::INTEGER AS n_items, 20 AS n_mask, round(list_sum(items), 6) AS first_sum, round(list_sum(prior), 6) AS prior_sum, round(items[1], 6) AS top FROM g""".replace("list_sum(items) AS _s, ", ""))
def day_sequences(spark, d):
    """Padded sequences of a day's vectors, described: items there, mask length, sums of first elements and of priors, and the first item."""
    e = table(spark, d, "embeddings").withColumn("day", F.col("vec_id") % 30)
    s = V.sequences(e, "day", "embedding", [F.desc("label"), F.asc("vec_id")], 2.0 + F.col("label"), 20, 64)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    there = F.filter("prior", lambda x: x > -1e8)
    return s.select("day", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_items"), F.size("mask").alias("n_mask"), r6(add(F.transform("items", lambda v: v[0])), "first_sum"), r6(add(there), "prior_sum"), r6(F.col("items")[0][0], "top"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS component, CAST(unnest(embedding) AS DOUBLE) AS loading FROM embeddings), r AS (SELECT component, vec_id::VARCHAR AS term, loading,
 row_number() OVER (PARTITION BY component ORDER BY loading DESC, vec_id::VARCHAR) AS h, row_number() OVER (PARTITION BY component ORDER BY loading, vec_id::VARCHAR) AS l FROM e)
 SELECT component::INTEGER AS component, 'high' AS side, term, round(loading, 6) AS loading FROM r WHERE h <= 12 UNION ALL SELECT component::INTEGER, 'low', term, round(loading, 6) FROM r WHERE l <= 12""")
def top_terms(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("term"), F.posexplode("embedding").alias("component", "v"))
    return V.top_terms(e.select("component", "term", F.col("v").cast("double").alias("loading"))).select("component", "side", "term", r6("loading", "loading"))


_POOL = "e AS (SELECT vec_id % 30 AS day, ln(2 + label) AS w, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@query(f"""WITH {_POOL}, m AS (SELECT day, pos, sum(CAST(v AS DOUBLE) * w) / sum(w) AS x FROM e GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY day) AS i FROM m)
 SELECT day, CAST(pos AS INTEGER) AS pos, round(sum(x * pow(2, i / 3.0)) OVER w / sum(pow(2, i / 3.0)) OVER w, 6) AS x FROM i WINDOW w AS (PARTITION BY pos ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def decayed_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("day", F.col("vec_id") % 30)
    return V.daily_vectors(e, "day", "embedding", F.ln(2.0 + F.col("label")), "decay").select("day", "pos", r6("x", "x"))


@query(f"WITH {_POOL} SELECT day, CAST(pos AS INTEGER) AS pos, round(sum(CAST(v AS DOUBLE) * exp(label)) / sum(exp(label)), 6) AS x FROM e GROUP BY 1, 2")
def attended_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("day", F.col("vec_id") % 30)
    return V.daily_vectors(e, "day", "embedding", F.lit(1.0), "attention", score=F.col("label").cast("double")).select("day", "pos", r6("x", "x"))


@query("""WITH t AS (SELECT page_id, lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages), w AS (SELECT page_id, list_filter(regexp_split_to_array(title, '\\s+'), lambda t: t <> '') AS w FROM t),
 c AS (SELECT page_id, len(list_filter(w, lambda t: t IN ('the', 'and'))) AS pos, len(list_filter(w, lambda t: t IN ('of', 'to', 'in'))) AS neg, len(w) AS n FROM w)
 SELECT page_id, pos::INTEGER AS lm_pos, neg::INTEGER AS lm_neg, n::INTEGER AS n_tokens, round((pos - neg) / nullif(n, 0), 6) AS score FROM c""")
def scored_articles(spark, d):
    """The scoring driver: a row an article with lexicon counts and net score, written once and read by whatever aggregates it."""
    w = X.tokens(F.lower(F.regexp_extract("html", X.PAGE_TITLE, 1)))
    path = scratch(spark, "scores")
    out = S.scored(table(spark, d, "pages").select("page_id", w.alias("w")), "page_id", "w", {"pos": ("the", "and"), "neg": ("of", "to", "in")}, path)
    return out.select("page_id", "lm_pos", "lm_neg", "n_tokens", r6("score", "score"))


@query(f"WITH {ART}, p AS (SELECT local_date, ln(1 + dup_count) AS w, tier / 3.0 AS a, (1 - tier / 3.0) / 2 AS b FROM art) SELECT local_date, round(sum(a * w) / sum(w), 6) AS p_down, round(sum(b * w) / sum(w), 6) AS p_up FROM p GROUP BY 1")
def class_prob_daily(spark, d):
    """Daily class probabilities of given article probabilities, weighted by syndication."""
    from ..operators import aggregates as A

    w, a = A.syndication_weight(F.col("dup_count")), F.col("tier") / 3.0
    return articles(spark, d).groupBy("local_date").agg(r6(A.weighted_mean(a, w), "p_down"), r6(A.weighted_mean((1 - a) / 2, w), "p_up"))


@query("SELECT event_id, '{\"alpha\":' || user_id || ',\"model\":\"' || event_type || '\"}' AS params FROM events")
def params_cell(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("alpha"), F.col("event_type").alias("model"))).alias("params"))


@query("SELECT vec_id, 64 + 2 AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + label + vec_id, 5) AS total FROM embeddings")
def feature_block(spark, d):
    """Blocks of features side by side in one vector; its length and sum."""
    e = table(spark, d, "embeddings")
    out = e.select("vec_id", V.block([F.col("embedding")], [F.col("label"), F.col("vec_id")]).alias("v"))
    return out.select("vec_id", F.size("v").alias("width"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), "total", 5))


@query()
def synthetic_articles(spark, d):
    """Seeded articles with planted shocks; values are this library's own."""
    return Y.articles(Y.weekdays(spark, "2024-01-01", "2024-06-28")).groupBy("theme_family", F.to_date("seen").alias("date")).agg(F.count("*").alias("n"))


@query(f"WITH {RET}, {'x AS (SELECT date, ret FROM rt WHERE ret IS NOT NULL)'} SELECT date, round(ret, 6) AS ret FROM x")
def finite_labels(spark, d):
    return returns(spark, d).where("ret IS NOT NULL").select("date", r6("ret", "ret"))
