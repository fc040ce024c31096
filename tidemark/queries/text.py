"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import query, r6, table

#: Whole page titles with outlet suffixes, markup, addresses and figures, as headlines have them; ASCII.
_TITLE = f"regexp_replace(regexp_extract(html, '{X.PAGE_TITLE}', 1), '[^ -~]', 'x', 'g')"
HEAD = f"""hd AS (SELECT page_id, {_TITLE} || CASE page_id % 6 WHEN 0 THEN ' rose 4.5% in the U.S. - Daily News' WHEN 1 THEN ' <b>won''t</b> pay $3.2bn | Al Monitor'
 WHEN 2 THEN ' see https://x.org/a?b=1 for 2,300 barrels' WHEN 3 THEN ' Beijing and the White House didn''t meet' WHEN 4 THEN ' 12 percent of studies, boxes and churches: Wire' ELSE '' END AS title FROM pages)"""
URLS = "ur AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?utm_source=x&id=3#top' WHEN 1 THEN '/?ref=home&fbclid=9' WHEN 2 THEN '/#a' ELSE '' END AS url, html FROM pages)"


def heads(spark, d):
    head = F.regexp_replace(F.regexp_extract("html", X.PAGE_TITLE, 1), "[^ -~]", "x")
    i = F.col("page_id") % 6
    tail = (
        F.when(i == 0, " rose 4.5% in the U.S. - Daily News").when(i == 1, " <b>won't</b> pay $3.2bn | Al Monitor").when(i == 2, " see https://x.org/a?b=1 for 2,300 barrels")
        .when(i == 3, " Beijing and the White House didn't meet").when(i == 4, " 12 percent of studies, boxes and churches: Wire").otherwise("")
    )
    return table(spark, d, "pages").select("page_id", F.concat(head, tail).alias("title"))


def urls(spark, d):
    i = F.col("page_id") % 4
    tail = F.when(i == 0, "?utm_source=x&id=3#top").when(i == 1, "/?ref=home&fbclid=9").when(i == 2, "/#a").otherwise("")
    return table(spark, d, "pages").select("page_id", F.concat("url", tail).alias("url"), "html")


def _re(column: str, pattern: str, new: str) -> str:
    return f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"




def _strip(column: str) -> str:
    return f"trim({_re(_re(_re(_re(column, X.TAG, ' '), X.URL, ' '), X.OUTLET, ''), chr(92) + 's+', ' ')})"


def _aliases(column: str) -> str:
    import re

    pairs = [(re.sub(r"([^\w\s])", r"\\\1", a).replace(" ", r"\s+"), n) for n, own in X.ALIASES.items() for a in own]
    for pattern, name in sorted(pairs, key=lambda p: -len(p[0])):
        # RE2 has no look-ahead: what follows a final full stop is kept by a group
        column = _re(column, rf"(?i)\b{pattern}(\W|$)", name + r"\1") if pattern.endswith(r"\.") else _re(column, rf"(?i)\b{pattern}\b", name)
    return column


def _contractions(column: str) -> str:
    for a, b in X.CONTRACTIONS.items():
        column = _re(column, f"(?i){a}", b)
    return column


def _masked(column: str) -> str:
    return _re(_re(_re(column, X.PCT, " <PCT> "), X.MONEY, " <MONEY> "), X.NUM, " <NUM> ")


def _tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '\\s+'), lambda t: t <> '')"


_STOPS = "(" + ", ".join(f"'{w}'" for w in sorted(set(X.STOP_WORDS) - set(X.KEEP_WORDS))) + ")"


def _lemma(t: str) -> str:
    rules = " ".join(f"WHEN length({t}) > {len(s) + 2} AND ends_with({t}, '{s}') THEN left({t}, length({t}) - {len(s)}) || '{r}'" for s, r in X.SUFFIXES)
    return f"CASE WHEN starts_with({t}, '<') THEN {t} {rules} ELSE {t} END"


@query(f"""WITH {HEAD} SELECT page_id, trim({_re(_re(f"lower({_re('trim(title)', X.OUTLET_OR_COLON, '')})", '[^a-z0-9 ]+', ' '), chr(92) + 's+', ' ')}) AS norm FROM hd""")
def norm_title(spark, d):
    return heads(spark, d).select("page_id", X.normal_title(F.col("title")).alias("norm"))


@query(f"""WITH {URLS} SELECT page_id, lower({_re(_re("split_part(url, '#', 1)", '[?&](utm_[^=&]+|fbclid|gclid|ref|src|amp)=[^&]*', ''), '[?&/]+$', '')}) AS canon FROM ur""")
def canon_url(spark, d):
    return urls(spark, d).select("page_id", X.canonical_url(F.col("url")).alias("canon"))


@query(f"WITH {HEAD} SELECT page_id, {_strip('title')} AS clean FROM hd")
def strip_boilerplate(spark, d):
    return heads(spark, d).select("page_id", X.strip_boilerplate(F.col("title")).alias("clean"))


@query(f"WITH {HEAD} SELECT page_id, {_aliases('title')} AS canon FROM hd")
def alias_canon(spark, d):
    return heads(spark, d).select("page_id", X.canonical_names(F.col("title")).alias("canon"))


@query(f"WITH {HEAD} SELECT page_id, {_contractions('title')} AS opened FROM hd")
def contractions(spark, d):
    return heads(spark, d).select("page_id", X.expand_contractions(F.col("title")).alias("opened"))


@query(f"WITH {HEAD} SELECT page_id, {_masked('title')} AS masked FROM hd")
def number_mask(spark, d):
    return heads(spark, d).select("page_id", X.mask_numbers(F.col("title")).alias("masked"))


@query(f"WITH {HEAD} SELECT page_id, {_re('title', '[^' + chr(92) + 'w' + chr(92) + 's<>]', ' ')} AS plain FROM hd")
def punctuation(spark, d):
    return heads(spark, d).select("page_id", X.strip_punctuation(F.col("title")).alias("plain"))


@query(f"WITH {HEAD}, t AS (SELECT page_id, {_tokens('lower(title)')} AS w FROM hd) SELECT page_id, array_to_string(list_filter(w, lambda t: t NOT IN {_STOPS}), ' ') AS kept, len(w)::INTEGER AS n FROM t")
def stopword_keep(spark, d):
    w = X.tokens(F.lower("title"))
    return heads(spark, d).select("page_id", F.array_join(X.drop_stop_words(w), " ").alias("kept"), F.size(w).alias("n"))


@query(f"WITH {HEAD}, t AS (SELECT page_id, {_tokens('lower(title)')} AS w FROM hd) SELECT page_id, array_to_string(list_transform(w, lambda t: {_lemma('t')}), ' ') AS lemmas FROM t")
def suffix_lemma(spark, d):
    return heads(spark, d).select("page_id", F.array_join(F.transform(X.tokens(F.lower("title")), X.lemma), " ").alias("lemmas"))


_A = _tokens(_re(f"lower({_masked(_contractions(_aliases(_strip('title'))))})", r"[^\w\s<>]", " "))


@query(f"""WITH {HEAD}, t AS (SELECT page_id, {_A} AS w FROM hd), u AS (SELECT page_id, list_filter(list_transform(list_filter(w, lambda t: t NOT IN {_STOPS}), lambda t: {_lemma('t')}), lambda t: length(t) > 1) AS w FROM t)
 SELECT page_id, CASE WHEN len(w) >= 3 THEN array_to_string(w, ' ') ELSE '' END AS track_a, CASE WHEN len(w) >= 3 THEN len(w) ELSE 0 END::INTEGER AS n_tokens_a FROM u""")
def track_a(spark, d):
    h = heads(spark, d).select("page_id", X.track_a(F.col("title")).alias("track_a"))
    return h.select("page_id", "track_a", X.n_tokens(F.col("track_a")).alias("n_tokens_a"))


@query(f"WITH t AS (SELECT doc_id, {_tokens(_strip(_re('text', '[^ -~]', ' ')))} AS w FROM documents) SELECT doc_id, array_to_string(w[1:128], ' ') AS track_b, least(len(w), 128)::INTEGER AS n_tokens_b FROM t")
def track_b(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.track_b(F.regexp_replace("text", "[^ -~]", " ")).alias("track_b"))
    return t.select("doc_id", "track_b", X.n_tokens(F.col("track_b")).alias("n_tokens_b"))


@query(f"WITH {HEAD}, t AS (SELECT page_id, {_tokens('lower(title)')} AS w FROM hd) SELECT page_id, array_to_string(list_filter(w, lambda t: t NOT IN {_STOPS}), ' ') AS with_keep_list, array_to_string(list_filter(w, lambda t: t NOT IN ({', '.join(repr(x) for x in sorted(set(X.STOP_WORDS)))})), ' ') AS without FROM t")
def negation_demo(spark, d):
    w = X.tokens(F.lower("title"))
    return heads(spark, d).select("page_id", F.array_join(X.drop_stop_words(w), " ").alias("with_keep_list"), F.array_join(X.drop_stop_words(w, ()), " ").alias("without"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))


_SLUG = f"'https://x.com/2017/01/' || lower(regexp_replace(regexp_replace({_TITLE}, '[^a-zA-Z ]', ' ', 'g'), ' +', '-', 'g')) || CASE page_id % 3 WHEN 0 THEN '.html?x=1' WHEN 1 THEN '.cms;v=2#a' ELSE '' END"
_ENDING = "(" + "|".join(e.replace(".", "[.]") for e in X.ENDINGS) + ")$"


@query(f"""WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract({_SLUG}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), ';[^/]*$', '') AS path FROM pages),
 s AS (SELECT page_id, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
  lambda s: list_filter(regexp_split_to_array(regexp_replace(s, '{_ENDING}', ''), '[-_+]'), lambda w: regexp_full_match(w, '[a-z]+'))) AS w FROM u),
 b AS (SELECT page_id, list_reduce(w, lambda a, x: CASE WHEN len(x) > len(a) THEN x ELSE a END) AS best FROM s)
 SELECT page_id, CASE WHEN len(best) >= 4 THEN array_to_string(best, ' ') END AS title FROM b""")
def slug_title(spark, d):
    title = F.regexp_replace(F.regexp_extract("html", X.PAGE_TITLE, 1), "[^ -~]", "x")
    slug = F.lower(F.regexp_replace(F.regexp_replace(title, "[^a-zA-Z ]", " "), " +", "-"))
    tail = F.when(F.col("page_id") % 3 == 0, ".html?x=1").when(F.col("page_id") % 3 == 1, ".cms;v=2#a").otherwise("")
    return table(spark, d, "pages").select("page_id", X.slug_title(F.concat(F.lit("https://x.com/2017/01/"), slug, tail)).alias("title"))


_LEX = {"neg": ("the", "and", "que"), "pos": ("that", "for", "und")}


@query(f"WITH t AS (SELECT conv_id, turn, {_tokens('lower(text)')} AS w FROM conversations) SELECT conv_id, turn, {', '.join(f'len(list_filter(w, lambda t: t IN {own}))::INTEGER AS lm_{n}' for n, own in _LEX.items())}, len(w)::INTEGER AS n_tokens FROM t")
def lexicon_counts(spark, d):
    w = X.tokens(F.lower("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", *[X.lexicon_count(w, own).alias(f"lm_{n}") for n, own in _LEX.items()], F.size(w).alias("n_tokens"))


@query("SELECT doc_id, regexp_matches(regexp_replace(text, '[^ -~]', 'x', 'g'), '(?i)\\b(?:of the|the|and)\\b') AS us, regexp_matches(regexp_replace(text, '[^ -~]', 'x', 'g'), '(?i)\\b(?:der|die|und)\\b') AS europe FROM documents")
def watchlist(spark, d):
    t = F.regexp_replace("text", "[^ -~]", "x")  # engines differ in word boundaries beyond ASCII
    return table(spark, d, "documents").select("doc_id", X.mentions(t, ("the", "and", "of the")).alias("us"), X.mentions(t, ("und", "die", "der")).alias("europe"))


@query(f"WITH t AS (SELECT conv_id, turn, {_tokens('lower(text)')} AS w FROM conversations), g AS (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def bigrams(spark, d):
    g = table(spark, d, "conversations").select(F.explode(X.ngrams(X.tokens(F.lower("text")), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS none, '{\"event_type\":\"' || event_type || '\"}' AS cell FROM events")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int, none string"))
    return e.select("event_id", "p.k", "p.none", F.to_json(F.struct("event_type")).alias("cell"))


@query("SELECT event_id, TRY_CAST(split_part(CAST(value AS VARCHAR) || ',2,3', ',', 1) AS DOUBLE) AS tone, TRY_CAST(split_part('x' || event_type || ',2', ',', 1) AS DOUBLE) AS bad FROM events")
def first_field(spark, d):
    return table(spark, d, "events").select("event_id", X.first_double(F.concat(F.col("value").cast("string"), F.lit(",2,3"))).alias("tone"), X.first_double(F.concat(F.lit("x"), "event_type", F.lit(",2"))).alias("bad"))


@query("WITH l AS (SELECT unnest(['the', 'and', 'that']) AS word, unnest(['a', 'a', 'b']) AS category), w AS (SELECT source, unnest(" + _tokens("lower(text)") + ") AS word FROM documents), c AS (SELECT source, category, count(*) AS n FROM w JOIN l USING (word) GROUP BY 1, 2) SELECT source, category, n, round(n * 1.0 / sum(n) OVER (PARTITION BY source), 6) AS share FROM c")
def large_lexicon(spark, d):
    """Counts through a join, for lexicons too large for an expression; words are counted before the join."""
    from pyspark.sql import Window as W

    lexicon = spark.createDataFrame([("the", "a"), ("and", "a"), ("that", "b")], "word string, category string")
    words = table(spark, d, "documents").select("source", F.explode(X.tokens(F.lower("text"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("k"))
    c = words.join(lexicon, "word").groupBy("source", "category").agg(F.sum("k").alias("n"))
    return c.select("source", "category", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("source")), "share"))
