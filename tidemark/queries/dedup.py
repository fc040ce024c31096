"""De-duplication and sampling queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as P
from ..operators import sampling as M
from ..sources import articles as S
from .base import ART, articles, query, table

#: Whole page titles seen an hour apart a page; addresses cut to hosts, so that neighbours share some.
TT = """tt AS (SELECT page_id AS id, page_id * 3600 AS t, trim(regexp_replace(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS norm,
 regexp_extract(url, '//([^/]+)', 1) || CAST(page_id // 30 AS VARCHAR) AS canon FROM pages)"""
_BITS = " + ".join(f"CASE WHEN sum(CASE WHEN ({h} >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN CAST({1 << b} AS HUGEINT) * {mult} ELSE 0 END" for h, mult in (("hi", 1 << 32), ("lo", 1)) for b in range(32))
SH = TT + f""", sg AS (SELECT id, unnest(CASE WHEN length(norm) = 0 THEN [NULL] ELSE list_transform(generate_series(1, greatest(length(norm) - 3, 1)), lambda i: substr(norm, i, 4)) END) AS s FROM tt),
 hh AS (SELECT id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(s), 9, 8))::BIGINT AS lo FROM sg),
 ff AS (SELECT id, CASE WHEN count(hi) = 0 THEN 0 ELSE {_BITS} END AS u FROM hh GROUP BY 1), fp AS (SELECT id, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END::BIGINT AS fp FROM ff)"""


def titles(spark, d):
    norm = F.trim(F.regexp_replace(F.lower(F.regexp_extract("html", X.PAGE_TITLE, 1)), "[^a-z0-9]+", " "))
    canon = F.concat(F.regexp_extract("url", "//([^/]+)", 1), F.floor(F.col("page_id") / 30))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 3600).alias("t"), norm.alias("norm"), canon.alias("canon"))


def prints(spark, d):
    t = titles(spark, d)
    return P.simhash(t, "id", F.col("norm")).join(t.select("id", "t"), "id")


@query(f"WITH {TT}, g AS (SELECT unnest(list_transform(generate_series(1, greatest(length(norm) - 3, 1)), lambda i: substr(norm, i, 4))) AS shingle FROM tt WHERE norm <> '') SELECT shingle, count(*) AS n FROM g GROUP BY 1")
def shingles(spark, d):
    return titles(spark, d).select(F.explode(P.shingles(F.col("norm"))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))


@query(f"WITH {SH} SELECT id, fp FROM fp")
def simhash(spark, d):
    return prints(spark, d).select("id", "fp")


@query(f"WITH {SH}, r AS (SELECT id, first_value(id) OVER (PARTITION BY canon ORDER BY t, id) AS other FROM tt) SELECT r.id AS id, other, bit_count(xor(a.fp, b.fp))::INTEGER AS bits FROM r JOIN fp a ON a.id = r.id JOIN fp b ON b.id = other WHERE r.id <> other")
def hamming_pairs(spark, d):
    """Bits in which each title's fingerprint differs from that of the first of its address."""
    p = prints(spark, d).select("id", "fp")
    pairs = P.url_edges(titles(spark, d)).withColumnRenamed("root", "other")
    q = p.select(F.col("id").alias("other"), F.col("fp").alias("fp2"))
    return pairs.join(p, "id").join(q, "other").select("id", "other", P.hamming(F.col("fp"), F.col("fp2")).alias("bits"))


@query(f"WITH {SH}, b AS (SELECT id, unnest(generate_series(0, 6)) AS band, fp FROM fp) SELECT id, band::INTEGER AS band, (CASE WHEN band = 0 THEN fp & 511 ELSE (fp >> (band * 9)) & 511 END)::BIGINT AS value FROM b")
def bands(spark, d):
    return prints(spark, d).select("id", F.inline(P.bands(F.col("fp"))))


@query(f"WITH {TT} SELECT id, first_value(id) OVER (PARTITION BY canon ORDER BY t, id) AS root FROM tt QUALIFY id <> root")
def url_dups(spark, d):
    return P.url_edges(titles(spark, d))


_NEXT = """ex AS (SELECT id, t, norm, row_number() OVER (PARTITION BY norm ORDER BY t, id) AS i FROM tt WHERE norm <> '')"""
_WIN = f"""WITH RECURSIVE {TT}, {_NEXT}, go AS (SELECT id, t, norm, i, t AS at, id AS root FROM ex WHERE i = 1 UNION ALL
 SELECT e.id, e.t, e.norm, e.i, CASE WHEN e.t - g.at > {{w}} THEN e.t ELSE g.at END, CASE WHEN e.t - g.at > {{w}} THEN e.id ELSE g.root END FROM go g JOIN ex e ON e.norm = g.norm AND e.i = g.i + 1)"""


@query(_WIN.format(w=172800) + " SELECT id, root FROM go WHERE id <> root")
def title_windows(spark, d):
    return P.title_edges(titles(spark, d))


_PAIRS = "np AS (SELECT a.id AS id, b.id AS root FROM (SELECT * FROM fp JOIN tt USING (id)) a JOIN (SELECT * FROM fp JOIN tt USING (id)) b ON b.id < a.id AND a.t - b.t <= {w} AND bit_count(xor(a.fp, b.fp)) <= 6)"


@query(f"WITH {SH}, {_PAIRS.format(w=360000)} SELECT id, root FROM np")
def simhash_pairs(spark, d):
    return P.near_pairs(prints(spark, d), 360000)


@query(f"""WITH RECURSIVE {TT}, ed AS (SELECT id, first_value(id) OVER (PARTITION BY canon ORDER BY id) AS root FROM tt UNION SELECT id, first_value(id) OVER (PARTITION BY norm ORDER BY id) FROM tt WHERE norm <> ''),
 both_ AS (SELECT id AS a, root AS b FROM ed UNION SELECT root, id FROM ed), re AS (SELECT id AS a, id AS b FROM tt UNION SELECT re.a, both_.b FROM re JOIN both_ ON re.b = both_.a) SELECT a AS id, min(b) AS root FROM re GROUP BY 1""")
def components(spark, d):
    t = titles(spark, d)
    by = lambda c: t.where("norm <> ''" if c == "norm" else "true").select("id", F.min("id").over(W.partitionBy(c)).alias("root"))
    return P.components(t, by("canon").union(by("norm")).where("id <> root"))


_FULL = f"""WITH RECURSIVE {SH}, {_NEXT}, go AS (SELECT id, t, norm, i, t AS at, id AS root FROM ex WHERE i = 1 UNION ALL
 SELECT e.id, e.t, e.norm, e.i, CASE WHEN e.t - g.at > 172800 THEN e.t ELSE g.at END, CASE WHEN e.t - g.at > 172800 THEN e.id ELSE g.root END FROM go g JOIN ex e ON e.norm = g.norm AND e.i = g.i + 1),
 {_PAIRS.format(w=172800).replace("SELECT * FROM fp JOIN tt USING (id)", "SELECT * FROM fp JOIN tt USING (id) WHERE norm <> ''")},
 ed AS (SELECT id, root FROM go UNION SELECT id, root FROM np UNION SELECT id, first_value(id) OVER (PARTITION BY canon ORDER BY t, id) FROM tt), both_ AS (SELECT id AS a, root AS b FROM ed UNION SELECT root, id FROM ed),
 re AS (SELECT id AS a, id AS b FROM tt UNION SELECT re.a, both_.b FROM re JOIN both_ ON re.b = both_.a), rt AS (SELECT a AS id, min(b) AS cluster_id FROM re GROUP BY 1),
 cl AS (SELECT id AS page_id, cluster_id, id <> cluster_id AS is_duplicate, count(*) OVER (PARTITION BY cluster_id) AS dup_count FROM rt)"""


def _articles(spark, d):
    """Pages with normal titles as titles, so that normalising again changes nothing."""
    at = F.timestamp_add("SECOND", F.col("t"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return titles(spark, d).select(F.col("id").alias("page_id"), F.col("norm").alias("title"), F.col("canon").alias("url"), at.alias("seen"))


@query(_FULL + " SELECT page_id, cluster_id, is_duplicate, dup_count FROM cl")
def dedup_full(spark, d):
    return P.deduplicate(_articles(spark, d), "page_id", "title", "url", "seen").select("page_id", "cluster_id", "is_duplicate", "dup_count")


@query(_FULL + " SELECT page_id, dup_count FROM cl WHERE NOT is_duplicate ORDER BY dup_count DESC, page_id LIMIT 10")
def top_clusters(spark, d):
    return P.top_syndicated(P.deduplicate(_articles(spark, d), "page_id", "title", "url", "seen"), 10, "page_id").select("page_id", "dup_count")


@query(f"""WITH {ART}, r AS (SELECT local_date, theme_family, article_id, row_number() OVER (PARTITION BY local_date, theme_family ORDER BY md5('42|' || local_date::VARCHAR || '|' || theme_family || '|' || article_id::VARCHAR), article_id) AS r FROM art) SELECT local_date, theme_family, article_id FROM r WHERE r <= 5""")
def cap_sample(spark, d):
    return S.cap_per_day(articles(spark, d), 5, 42, "local_date", "theme_family", "article_id").select("local_date", "theme_family", "article_id")


@query(f"""WITH {ART}, r AS (SELECT theme_family, tier <> 0 AS kept, article_id, row_number() OVER (PARTITION BY theme_family, tier <> 0 ORDER BY md5('7|' || article_id::VARCHAR), article_id) AS r FROM art) SELECT theme_family, kept, article_id FROM r WHERE r <= CASE WHEN kept THEN 14 ELSE 6 END""")
def strat_sample(spark, d):
    """20 a family, 70 % of them kept rows."""
    a = articles(spark, d).withColumn("kept", F.col("tier") != 0)
    return M.stratified(a, ["theme_family", "kept"], F.when(F.col("kept"), 14).otherwise(6), 7, "article_id").select("theme_family", "kept", "article_id")


@query(f"WITH {ART} SELECT article_id FROM art ORDER BY md5('3|' || article_id::VARCHAR), article_id LIMIT 25")
def seeded_rows(spark, d):
    return M.hashed(articles(spark, d), 25, 3, "article_id").select("article_id")
