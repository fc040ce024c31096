"""Gate, funnel and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gates as G
from ..sources import articles as S
from .base import query, r6, table

#: Documents as articles: the text, in ASCII, as title, source as domain, language as country.
DOC = """da AS (SELECT doc_id, regexp_replace(text, '[^ -~]', 'x', 'g') AS title, CASE WHEN source IN ('src1', 'src2') THEN 'www.' || source || '.co.uk' WHEN source = 'src3' THEN 'my' || source || '.com'
 ELSE source || '.com' END AS domain, upper(lang) AS country, doc_id % 7 = 0 AS is_duplicate, CASE WHEN doc_id % 3 = 0 THEN 'energy' WHEN doc_id % 3 = 1 THEN 'trade' ELSE 'conflict' END AS theme_family FROM documents)"""
TIERS = {1: ("src1.co.uk", "src4.com"), 2: ("src5.com", "src6.com", "src3.com")}
STATE = ("src5.com",)
BLOCK = ("src7.com", "*rc8.*", "src9.com/news")
TERMS = ("that", "the of", "erth", "un la", "and", "der")


def _within(names):
    return "(" + " OR ".join(f"domain = '{n}' OR ends_with(domain, '.{n}')" for n in names) + ")"


TIERED = DOC + f""", ti AS (SELECT *, CASE WHEN {_within(TIERS[1])} THEN 1 WHEN {_within(TIERS[2])} THEN 2 ELSE 3 END AS source_tier, {_within(STATE)} AS is_state_affiliated,
 (contains(domain, 'src7.com') OR regexp_full_match(domain, '.*rc8[.].*') OR contains(domain, 'src9.com/news')) AS is_blocked_domain FROM da)"""
_TERM = r"(?i)\b(?:" + "|".join(sorted(TERMS, key=lambda t: (-len(t), t))) + r")\b"
GATED = TIERED + f""", ga AS (SELECT *, NOT is_blocked_domain AS pass_source, country IN ('EN', 'DE') AS has_actor_country, regexp_matches(title, '{_TERM}') AS has_market_term FROM ti),
 fu AS (SELECT *, has_actor_country OR has_market_term AS pass_materiality, pass_source AND (has_actor_country OR has_market_term) AND NOT is_duplicate AS keep FROM ga)"""


def doc_articles(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select(
        "doc_id", F.regexp_replace("text", "[^ -~]", "x").alias("title"),
        F.when(s.isin("src1", "src2"), F.concat(F.lit("www."), s, F.lit(".co.uk"))).when(s == "src3", F.concat(F.lit("my"), s, F.lit(".com"))).otherwise(F.concat(s, F.lit(".com"))).alias("domain"),
        F.upper("lang").alias("country"), (F.col("doc_id") % 7 == 0).alias("is_duplicate"),
        F.when(F.col("doc_id") % 3 == 0, "energy").when(F.col("doc_id") % 3 == 1, "trade").otherwise("conflict").alias("theme_family"),
    )


def gated(spark, d):
    out = G.source_gate(doc_articles(spark, d), TIERS, STATE, BLOCK)
    out = out.withColumns({"has_actor_country": F.col("country").isin("EN", "DE"), "has_market_term": X.mentions(F.col("title"), TERMS)})
    return G.funnel(G.materiality(out, ["actor_country", "market_term"]))


@query("""SELECT event_id::VARCHAR AS url, ts AS seendate_utc, lower(trim('  ' || event_type || ' ')) AS language, upper('c' || user_id % 30) AS sourcecountry, CAST(NULL AS VARCHAR) AS theme_family
 FROM events WHERE event_id % 5 <> 0""")
def schema_pin(spark, d):
    """Articles of two stamp formats, pinned to the schema; rows without a time go."""
    e = table(spark, d, "events")
    stamp = F.when(F.col("event_id") % 5 == 0, "never").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss.SSSSSS'Z'")).otherwise(F.col("ts").cast("string"))
    raw = e.select(F.col("event_id").cast("string").alias("url"), F.lit("t").alias("title"), stamp.alias("seendate"), F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("language"), F.concat(F.lit("c"), F.col("user_id") % 30).alias("sourcecountry"))
    return S.pin(raw, "yyyyMMdd'T'HHmmss.SSSSSS'Z'").select("url", F.col("seendate_utc"), "language", "sourcecountry", "theme_family")


@query(f"WITH {TIERED} SELECT doc_id, CAST(source_tier AS INTEGER) AS source_tier, is_state_affiliated FROM ti")
def source_tier(spark, d):
    return G.source_gate(doc_articles(spark, d), TIERS, STATE, BLOCK).select("doc_id", "source_tier", "is_state_affiliated")


@query(f"WITH {TIERED} SELECT doc_id, domain, is_blocked_domain FROM ti")
def blocklist(spark, d):
    return G.source_gate(doc_articles(spark, d), TIERS, STATE, BLOCK).select("doc_id", "domain", "is_blocked_domain")


@query(f"WITH {TIERED} SELECT doc_id, NOT is_blocked_domain AS soft, NOT is_blocked_domain AND source_tier <= 2 AS hard FROM ti")
def source_gate(spark, d):
    g = doc_articles(spark, d)
    soft = G.source_gate(g, TIERS, STATE, BLOCK).select("doc_id", F.col("pass_source").alias("soft"), "is_blocked_domain", "source_tier")
    return soft.select("doc_id", "soft", G.passes_source(hard=True).alias("hard"))


@query(f"WITH {DOC} SELECT doc_id, regexp_matches(title, '{_TERM}') AS has_term, false AS never FROM da")
def term_gate(spark, d):
    return doc_articles(spark, d).select("doc_id", X.mentions(F.col("title"), TERMS).alias("has_term"), X.mentions(F.col("title"), []).alias("never"))


@query(f"WITH {GATED} SELECT doc_id, has_actor_country, has_market_term, pass_materiality FROM fu")
def materiality(spark, d):
    return gated(spark, d).select("doc_id", "has_actor_country", "has_market_term", "pass_materiality")


@query(f"WITH {GATED} SELECT doc_id, pass_source, is_duplicate, keep FROM fu")
def funnel_keep(spark, d):
    return gated(spark, d).select("doc_id", "pass_source", "is_duplicate", "keep")


@query(f"WITH {GATED} SELECT doc_id, title FROM fu WHERE keep")
def kept_scan(spark, d):
    """Kept rows, two columns of them."""
    return gated(spark, d).where("keep").select("doc_id", "title")


@query("""WITH t AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ') AS w FROM documents)
 SELECT doc_id, list_has_any(w, ['the', 'that']) AS en, list_has_any(w, ['der', 'und']) AS de, len(list_intersect(list_distinct(w), ['the', 'that', 'der', 'und', 'and']))::INTEGER AS n FROM t""")
def theme_tokens(spark, d):
    """Exact tokens: a code that starts with another one is not it."""
    title = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    t = table(spark, d, "documents").select("doc_id", X.theme_tokens(F.replace(title, F.lit(" "), F.lit(";")), F.replace(title, F.lit(" "), F.lit(",1;"))).alias("w"))
    own = lambda *x: F.array(*[F.lit(i) for i in x])
    return t.select("doc_id", F.arrays_overlap("w", own("the", "that")).alias("en"), F.arrays_overlap("w", own("der", "und")).alias("de"), F.size(F.array_intersect("w", own("the", "that", "der", "und", "and"))).alias("n"))


@query("SELECT event_id, CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' AND date_diff('day', DATE '2024-01-03', CAST(ts AS DATE)) % 3 = 0")
def stride_days(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("date"))
    return G.period(e, "date", "2024-01-03", "2024-01-24", 3)


@query(f"""WITH {GATED}, c AS (SELECT count(*) AS raw, count(*) FILTER (WHERE pass_source) AS src, count(*) FILTER (WHERE pass_source AND pass_materiality) AS mat, count(*) FILTER (WHERE keep) AS kept FROM fu)
 SELECT stage, n, removed FROM (SELECT '0 raw' AS stage, raw AS n, 0::BIGINT AS removed FROM c UNION ALL SELECT '1 source', src, raw - src FROM c UNION ALL SELECT '2 materiality', mat, src - mat FROM c UNION ALL SELECT '3 dedup', kept, mat - kept FROM c)""")
def funnel_attrition(spark, d):
    return G.attrition(gated(spark, d))


@query(f"""WITH {GATED} SELECT theme_family, count(*) AS n_raw, count(*) FILTER (WHERE keep) AS n_kept, round(100.0 * count(*) FILTER (WHERE keep) / count(*), 6) AS retention_pct,
 round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_raw_pct, round(100.0 * count(*) FILTER (WHERE keep) / sum(count(*) FILTER (WHERE keep)) OVER (), 6) AS share_kept_pct FROM fu GROUP BY 1""")
def family_balance(spark, d):
    return G.balance(gated(spark, d), "theme_family").select("theme_family", "n_raw", "n_kept", *[r6(c, c) for c in ("retention_pct", "share_raw_pct", "share_kept_pct")])


@query(f"""WITH {GATED} SELECT count(*) AS n, count(DISTINCT domain) AS domains, count(DISTINCT country) AS countries, count(*) FILTER (WHERE trim(title) = '') AS blank_titles,
 round(100.0 * count(DISTINCT title) / count(*), 6) AS unique_title_pct, round(100.0 * avg(is_duplicate::INT), 6) AS duplicate_pct FROM fu""")
def corpus_quality(spark, d):
    f = gated(spark, d)
    return f.agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.count_distinct("country").alias("countries"), F.count_if(F.trim("title") == "").alias("blank_titles"), r6(100 * F.count_distinct("title") / F.count("*"), "unique_title_pct"), r6(100 * F.avg(F.col("is_duplicate").cast("int")), "duplicate_pct"))


@query("SELECT word, w[1]::INTEGER AS neg, w[2]::INTEGER AS pos FROM (SELECT lower(p_name) AS word, [CASE WHEN p_size > 25 THEN 1 ELSE 0 END, CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END] AS w FROM part) WHERE w[1] + w[2] > 0")
def lexicon_build(spark, d):
    """A master dictionary to lower-case words with 0/1 flags, rows with any flag."""
    raw = table(spark, d, "part").select(F.col("p_name").alias("Word"), F.greatest(F.col("p_size") - 25, F.lit(0)).alias("neg"), F.greatest(F.col("p_retailprice") - 1500, F.lit(0)).alias("pos"))
    return S.build_lexicon(raw, ["neg", "pos"])
