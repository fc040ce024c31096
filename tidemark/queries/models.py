"""Vector, term and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import models as M
from .base import query, r6, table
from .evaluation import predictions

_W = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')"


def talk(spark, d):
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", X.tokens(F.lower("text")).alias("w"))


TALK = f"tk AS (SELECT conv_id * 1000 + turn AS id, conv_id, {_W} AS w FROM conversations)"


@query("WITH e AS (SELECT vec_id % 30 AS day, ln(2 + label) AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT day, CAST(pos AS INTEGER) AS pos, round(sum(CAST(v AS DOUBLE) * w) / sum(w), 6) AS x FROM e GROUP BY 1, 2")
def daily_vectors(spark, d):
    p = M.pooled(table(spark, d, "embeddings"), F.col("vec_id") % 30, "embedding", F.ln(2.0 + F.col("label")))
    return p.select("day", "pos", r6("x", "x"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings) SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first, round(CAST(embedding[64] AS DOUBLE) / n, 6) AS last FROM n")
def l2_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", M.l2_norm(F.col("embedding")).alias("u"))
    return e.select("vec_id", r6(F.col("u")[0], "first"), r6(F.col("u")[63], "last"))


@query(f"""WITH {TALK}, n AS (SELECT count(*) AS n FROM tk WHERE conv_id % 3 <> 0), f AS (SELECT id, conv_id % 3 <> 0 AS fit, unnest(w) AS term FROM tk), tf AS (SELECT id, fit, term, count(*) AS tf FROM f GROUP BY 1, 2, 3),
 df AS (SELECT term, count(*) AS df FROM tf, n WHERE fit GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.5 * any_value(n)), x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) * 1.0 / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
 SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x""")
def tfidf_terms(spark, d):
    t = M.tfidf(talk(spark, d), "id", F.col("w"), F.col("conv_id") % 3 != 0, 3)
    return t.select("id", "term", r6("weight", "weight"))


@query(f"""WITH {TALK}, t AS (SELECT id, unnest(list_distinct(w)) AS w FROM tk), fr AS (SELECT w FROM t GROUP BY 1 HAVING count(*) >= 8), o AS (SELECT id, w FROM t JOIN fr USING (w)),
 p AS (SELECT a.w AS w, b.w AS c, count(*) AS n FROM o a JOIN o b USING (id) WHERE a.w <> b.w GROUP BY 1, 2), r AS (SELECT w, sum(n)::DOUBLE AS nw FROM p GROUP BY 1), tt AS (SELECT sum(nw) AS t, sum(pow(nw, 0.75)) AS ta FROM r),
 m AS (SELECT p.w, p.c, ln((n / t) / ((r.nw / t) * (pow(q.nw, 0.75) / ta))) AS pmi FROM p JOIN r USING (w) JOIN r q ON q.w = p.c, tt) SELECT w, c, round(pmi, 6) AS pmi FROM m WHERE pmi > 0""")
def ppmi_pairs(spark, d):
    return M.ppmi(talk(spark, d), "id", F.col("w"), 8).select("w", "c", r6("pmi", "pmi"))


@query(f"""WITH {TALK}, c AS (SELECT conv_id % 4 AS topic, term, count(*) AS n FROM (SELECT conv_id, unnest(w) AS term FROM tk) GROUP BY 1, 2), s AS (SELECT topic, sum(n) AS size FROM c GROUP BY 1), a AS (SELECT term, sum(n) AS total FROM c GROUP BY 1),
 k AS (SELECT topic, term, n / size * ln(1 + (SELECT avg(size) FROM s) / total) AS score FROM c JOIN s USING (topic) JOIN a USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM k)
 SELECT topic, term, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 8""")
def ctfidf(spark, d):
    t = talk(spark, d).withColumn("topic", F.col("conv_id") % 4)
    return M.topic_terms(t, "topic", F.col("w")).select("topic", "term", r6("score", "score"), "rank")


_X = ["n", "price", "p"]


@query()
def ridge(spark, d):
    p = predictions(spark, d)
    scaler, model = M.ridge(p.where("split = 'train'"), _X, "ret", 100.0)
    return model.transform(scaler.transform(p.where("split = 'test'"))).select("date", "ret", "prediction")


@query()
def logreg(spark, d):
    p = predictions(spark, d)
    return M.probabilities(M.logistic(p.where("split = 'train'"), _X, "truth", 0.1), p.where("split = 'test'")).select("date", "truth", "p_DOWN", "p_FLAT", "p_UP")


@query()
def boosted_trees(spark, d):
    p = predictions(spark, d)
    return M.boosted_probabilities(M.boosted(p.where("split = 'train'"), _X, "truth", 5, 2), p.where("split = 'test'")).select("date", "truth", "p_DOWN", "p_FLAT", "p_UP")


@query()
def ar_forecast(spark, d):
    p = predictions(spark, d).select(F.lit("y").alias("series"), "date", "ret")
    return M.ar_forecast(p, "series", "date", "ret", (1, 2, 3), "1999-01-01")


@query()
def pca(spark, d):
    e = table(spark, d, "embeddings")
    return M.pca(e.where("vec_id % 5 <> 0"), e, "embedding", 4).select("vec_id", *[F.col("scores")[i].alias(f"pc{i}") for i in range(4)])


@query()
def kmeans(spark, d):
    e = table(spark, d, "embeddings")
    return M.topics(e.where("vec_id % 5 <> 0"), e, "embedding", 5).select("vec_id", "topic")


@query()
def svd(spark, d):
    day = M.vectors_of(M.pooled(table(spark, d, "embeddings"), F.col("vec_id") % 30, "embedding", F.lit(1.0)))
    return M.svd(day, "vector", 3, "day").select("day", *[F.col("scores")[i].alias(f"s{i}") for i in range(3)])
