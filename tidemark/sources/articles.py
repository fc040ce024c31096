"""Article sources: bulk records of 27 tab-separated fields, interface payloads, lexicons; and their sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import text as X

REQUIRED = ("url", "title", "seendate", "domain", "language", "sourcecountry", "theme_family", "query_day")
#: Fixed positions in a bulk record.
DATE, DOMAIN, URL, THEMES1, THEMES2, PLACES, TONE, EXTRAS, FIELDS = 1, 3, 4, 7, 8, 9, 15, 26, 27


def pin(df: DataFrame, stamp: str = "yyyyMMdd'T'HHmmss'Z'") -> DataFrame:
    """Pin the article schema: missing columns null, two time formats, trimmed and folded codes; rows without time, title or address go."""
    for c in REQUIRED:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    seen = F.coalesce(F.try_to_timestamp("seendate", F.lit(stamp)), F.try_to_timestamp("seendate")).cast("timestamp_ntz")
    out = df.withColumns({"seendate_utc": seen, "domain": F.lower(F.trim("domain")), "language": F.lower(F.trim("language")), "sourcecountry": F.upper(F.trim("sourcecountry")), "title": F.trim("title")})
    return out.dropna(subset=["seendate_utc", "title", "url"])


def slots(start: str, end: str, per_day: int, stride: int = 1, offset: int = 0) -> Column:
    """Stamps of all slots of a period."""
    return F.flatten(F.transform(D.date_grid(F.lit(start).cast("date"), F.lit(end).cast("date"), stride), lambda d: D.slot_stamps(d, per_day, offset)))


def slot_url(stamp: Column, base: str) -> Column:
    return F.format_string(f"{base.rstrip('/')}/%s.gkg.csv.zip", stamp)


def unzipped(files: DataFrame) -> DataFrame:
    """Lines of the first member of each zip archive of ``files`` (path, content): (path, ok, value).

    An archive that can't be read gives one row with ``ok`` false. Spark reads gzip
    itself, but not zip.
    """

    def lines(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                        text = f.read().decode("utf-8", "replace")
                    yield pd.DataFrame({"path": name, "ok": True, "value": text.split("\n")})
                except (zipfile.BadZipFile, IndexError):
                    yield pd.DataFrame({"path": [name], "ok": [False], "value": [None]})

    return files.select("path", "content").mapInPandas(lines, "path string, ok boolean, value string")


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the zip archives that have landed under ``path``, by :func:`unzipped`."""
    return unzipped(spark.read.format("binaryFile").load(path))


def slot_states(wanted: DataFrame, lines: DataFrame, matches: Column) -> DataFrame:
    """(path, state) of each wanted file: hit, miss (no line ``matches``), fail (unreadable) or missing (never landed)."""
    seen = lines.groupBy("path").agg(F.bool_and("ok").alias("ok"), F.bool_or(F.coalesce(matches, F.lit(False))).alias("hit"))
    state = F.when(F.col("ok").isNull(), "missing").when(~F.col("ok"), "fail").when(F.col("hit"), "hit").otherwise("miss")
    return wanted.join(seen, "path", "left").select("path", state.alias("state"))


def census(spark: SparkSession, start: str, end: str, families: Mapping[str, Iterable[str]], languages: Iterable[str] = (), stride: int = 1, chunks: int = 1, earliest: str | None = None) -> DataFrame:
    """The requests of a census: (query_day, theme_family, query, chunk, window_start, window_end), one for each day, family and part of the day.

    Families have requests of their own, so that a cap on answers never lets a busy family crowd out another.
    """
    day = F.explode(D.date_grid(F.greatest(F.lit(start), F.lit(earliest or start)).cast("date"), F.lit(end).cast("date"), stride)).alias("query_day")
    family = F.explode(F.array(*[F.struct(F.lit(f).alias("theme_family"), F.lit(theme_query(t, languages)).alias("query")) for f, t in families.items()])).alias("f")
    grid = spark.range(1).select(day).select("query_day", family).select("query_day", "f.*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    minutes = 24 * 60 // chunks
    at = lambda k: F.timestamp_add("MINUTE", (k * minutes).cast("int"), F.col("query_day").cast("timestamp_ntz"))
    return grid.select("*", at(F.col("chunk")).alias("window_start"), at(F.col("chunk") + 1).alias("window_end"))


def parse_records(lines: DataFrame, families: Mapping[str, Iterable[str]]) -> DataFrame:
    """Records of ``value`` lines that carry a theme of a family, exactly: date, domain, url, title, families, tone, country.

    Lines with too few fields go. The title is the page title, else the words of the
    address. Wide fields are dropped by the projection before anything is shuffled.
    """
    f = lines.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.split("value", "\t").alias("f")).where(F.size("f") >= FIELDS)
    found = X.theme_tokens(F.col("f")[THEMES1], F.col("f")[THEMES2])
    own = F.array_compact(F.array(*[F.when(F.arrays_overlap(found, F.array(*[F.lit(t) for t in themes])), F.lit(name)) for name, themes in families.items()]))
    page = F.nullif(F.trim(unescaped(F.regexp_extract(F.col("f")[EXTRAS], "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1))), F.lit(""))
    slug = X.slug_title(F.col("f")[URL])
    return f.withColumn("families", own).where(F.size("families") > 0).select(
        F.col("f")[DATE].alias("date"), F.lower(F.col("f")[DOMAIN]).alias("domain"), F.col("f")[URL].alias("url"), F.coalesce(page, slug).alias("title"),
        F.when(page.isNotNull(), "page_title").when(slug.isNotNull(), "url_slug").alias("title_source"), "families", X.first_double(F.col("f")[TONE]).alias("tone"), primary_country(F.col("f")[PLACES]).alias("country"),
    )


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities resolved; Spark has no such function."""
    import html

    return text.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def primary_country(places: Column) -> Column:
    """Most mentioned country code of ``type#name#CC#...;...``, the first in order of equals; null without any."""
    codes = F.filter(F.transform(F.split(F.coalesce(places, F.lit("")), ";"), lambda p: F.split_part(p, F.lit("#"), F.lit(3))), lambda c: c != "")
    kinds = F.array_sort(F.array_distinct(codes))
    counted = F.transform(kinds, lambda k: F.struct(F.size(F.filter(codes, lambda c: c == k)).alias("n"), k.alias("code")))
    best = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("code")), lambda a, c: F.when(c["n"] > a["n"], c).otherwise(a))
    return best["code"]


def explode_families(records: DataFrame) -> DataFrame:
    """A row for each article and theme family."""
    return records.withColumn("theme_family", F.explode("families")).drop("families")


def cap_per_day(df: DataFrame, cap: int, seed: int, day: str, family: str, key: str) -> DataFrame:
    """At most ``cap`` rows a day and family, drawn by hashed key: the same rows in any input order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(day).cast("string"), family, F.col(key).cast("string")))
    rank = F.row_number().over(W.partitionBy(day, family).orderBy(order, key))
    return df.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def slice_volume(rows: DataFrame, ok_slots: DataFrame) -> DataFrame:
    """Volume by day and family: rows before any cap over slots retrieved; tone as the mean of those given.

    ``rows``: day, theme_family, tone; ``ok_slots``: day, slot of slices that came. A missing slice lowers neither.
    """
    retrieved = ok_slots.groupBy("day").agg(F.count_distinct("slot").alias("ok"))
    return rows.groupBy("day", "theme_family").agg(F.count("*").alias("n"), F.avg("tone").alias("tone")).join(retrieved, "day").withColumn("volume", F.try_divide("n", "ok")).select("day", "theme_family", "volume", "tone")


def scored(articles: DataFrame, key: str, words: str, lexicons: Mapping[str, Iterable[str]], path: str) -> DataFrame:
    """(key, lm_<name>..., n_tokens, score) a row an article, written to ``path`` unless it is there already.

    ``score`` is the share of ``pos`` words less that of ``neg`` words; null without words.
    """
    spark = articles.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        counts = {f"lm_{n}": X.lexicon_count(F.col(words), own) for n, own in lexicons.items()} | {"n_tokens": F.size(words)}
        out = articles.select(key, *[c.alias(n) for n, c in counts.items()])
        out.withColumn("score", F.try_divide(F.col("lm_pos") - F.col("lm_neg"), F.nullif(F.col("n_tokens"), F.lit(0)))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_lexicon(raw: DataFrame, categories: list[str], word: str = "Word") -> DataFrame:
    """Lower-case words with a 0/1 flag a category (above zero in the master list), rows with any flag."""
    missing = {word, *categories} - set(raw.columns)
    if missing:
        raise ValueError(f"the dictionary lacks {sorted(missing)}")
    out = raw.select(F.lower(word).alias("word"), *[(F.col(c) > 0).cast("int").alias(c) for c in categories])
    return out.where(" OR ".join(f"{c} = 1" for c in categories))


def read_lexicon(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """(word, category) of a lexicon file: one row a membership."""
    raw = spark.read.schema("word string, " + ", ".join(f"{c} int" for c in categories)).csv(path, header=True)
    return raw.select(F.lower("word").alias("word"), *categories).unpivot("word", categories, "category", "flag").where("flag > 0").select("word", "category")


def theme_query(themes: Iterable[str], languages: Iterable[str] = ()) -> str:
    """Query text of an article search: any of the themes in any of the languages."""
    themes = list(themes)
    if not themes:
        raise ValueError("a query needs a theme")
    either = lambda key, values: values[0] if len(values) == 1 else "(" + " OR ".join(values) + ")"
    out = either("theme", [f"theme:{t}" for t in themes])
    own = [f"sourcelang:{x}" for x in languages]
    return f"{out} {either('lang', own)}" if own else out


ARTICLES_JSON = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>"
TIMELINE_JSON = "timeline array<struct<data:array<struct<date:string,value:double>>>>"


def parse_article_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Articles of landed interface payloads; missing keys are null and broken payloads have none."""
    rest = [c for c in payloads.columns if c != column]
    return payloads.select(*rest, F.inline(F.from_json(column, ARTICLES_JSON)["articles"]))


def parse_timeline_payloads(payloads: DataFrame, metric: str, column: str = "payload") -> DataFrame:
    """Tidy rows (theme_family, date, value, metric) of landed timeline payloads (theme_family, payload)."""
    points = F.from_json(column, TIMELINE_JSON)["timeline"][0]["data"]
    return payloads.select("theme_family", F.inline(points)).select("theme_family", F.to_date(F.substring("date", 1, 8), "yyyyMMdd").alias("date"), "value", F.lit(metric).alias("metric"))


