"""Source and sink queries on surrogate inputs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import articles as A
from ..sources import series as S
from .base import prices, query, r6, table


@query("SELECT strftime(DATE '2024-01-01' + CAST(d AS INTEGER), '%Y%m%d') || lpad(CAST(m // 60 AS VARCHAR), 2, '0') || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || '00' AS stamp FROM (SELECT d, CAST(floor((i * 288.0 + 20) / 15) * 15 AS INTEGER) % 1440 AS m FROM generate_series(0, 6, 2) x(d), generate_series(0, 4) y(i))")
def slot_schedule(spark, d):
    return spark.range(1).select(F.explode(A.slots("2024-01-01", "2024-01-07", 5, 2, 20)).alias("stamp"))


@query("SELECT event_id, 'http://h/g/' || strftime(ts, '%Y%m%d%H%M%S') || '.gkg.csv.zip' AS url FROM events")
def slot_urls(spark, d):
    return table(spark, d, "events").select("event_id", A.slot_url(F.date_format("ts", "yyyyMMddHHmmss"), "http://h/g/").alias("url"))


@query("""WITH b AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), l AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY o_orderkey DESC) AS r FROM b) SELECT date, o_totalprice AS value FROM l WHERE r = 1""")
def sheet_scan(spark, d):
    """Orders as a sheet: a title block, a header row, US stamps, some bad values."""
    o = table(spark, d, "orders")
    bad = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    body = o.select((F.col("o_orderkey") + 10).alias("row_no"), F.array(F.lit("1"), F.date_format("o_orderdate", "M/d/yyyy h:mm:ss a"), bad, F.lit(None)).alias("cells"))
    top = spark.createDataFrame([(0, ["", "", "", None]), (1, ["", "Kurs JISDOR", "", None]), (2, ["NO", "Tanggal", "Kurs", None])], "row_no long, cells array<string>")
    return S.parse_sheet(top.union(body))


@query("SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_max(round(o_totalprice, 2), o_orderkey) AS value FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2")
def chart_scan(spark, d):
    """Orders as chart payloads, one a ticker and month: parallel arrays of times and closes in order of keys, some of them null."""
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    # seconds of a day follow the keys; a fuller day's last ones share its last second, where the place in the payload tells
    second = F.least(F.row_number().over(W.partitionBy("o_orderpriority", day).orderBy("o_orderkey")) - 1, F.lit(86_399))
    t = F.unix_date(day).cast("long") * 86_400 - 7 * 3600 + second
    o = o.select("o_orderpriority", "o_orderkey", F.trunc(day, "month").alias("month"), t.alias("t"), F.when(F.col("o_orderkey") % 5 != 0, F.round("o_totalprice", 2)).alias("c"))
    own = o.groupBy(F.col("o_orderpriority").alias("ticker"), "month").agg(F.array_sort(F.collect_list(F.struct("t", "o_orderkey", "c"))).alias("p"))
    chart = F.struct(F.array(F.struct(F.transform("p", lambda x: x["t"]).alias("timestamp"), F.struct(F.array(F.struct(F.transform("p", lambda x: x["c"]).alias("close"))).alias("quote")).alias("indicators"))).alias("result"))
    return S.parse_chart(own.select("ticker", F.to_json(F.struct(chart.alias("chart")), {"ignoreNullFields": "false"}).alias("payload")))


@query("""SELECT event_id, event_type AS theme_family, CASE WHEN event_id % 4 = 0 THEN 'page ' || event_id ELSE 'fed holds rates again' END AS title, round(value, 4) AS tone, 'C' || user_id % 9 AS country
 FROM events WHERE event_type IN ('view', 'click')""")
def record_parse(spark, d):
    """Events as bulk records of 27 fields; only those with a theme of a family come back, one row a family."""
    e = table(spark, d, "events")
    fields = {A.DATE: F.lit("20240101000000"), A.DOMAIN: F.lit("X.com"), A.URL: F.concat(F.lit("https://x.com/1/fed-holds-rates-again.html?i="), "event_id"), A.THEMES1: F.concat(F.upper("event_type"), F.lit(";")), A.THEMES2: F.concat(F.upper("event_type"), F.lit("SPILL,3")),
              A.PLACES: F.concat(F.lit("1#a#C"), F.col("user_id") % 9, F.lit("#x;1#b#C"), F.col("user_id") % 9, F.lit("#x;1#c#ZZ#x")), A.TONE: F.concat(F.round("value", 4), F.lit(",2,3")),
              A.EXTRAS: F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("<PAGE_TITLE>page "), "event_id", F.lit("</PAGE_TITLE>"))).otherwise("")}
    lines = e.select(F.concat_ws("\t", *[fields.get(i, F.lit("")) for i in range(A.FIELDS)]).alias("value")).union(spark.createDataFrame([("too\tshort",)], "value string"))
    r = A.explode_families(A.parse_records(lines, {"view": ["VIEW"], "click": ["CLICK"]}))
    return r.select(F.split_part("url", F.lit("i="), F.lit(2)).cast("long").alias("event_id"), "theme_family", "title", "tone", "country")


@query("WITH p AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT split, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, min(price) AS min, max(price) AS max FROM (SELECT *, CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split FROM p) GROUP BY 1")
def split_summary(spark, d):
    from ..operators.windows import chronological_split

    p = prices(spark, d).withColumn("split", chronological_split(F.col("date"), "1998-06-30", "1999-12-31"))
    return p.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg("price"), "mean", 4), r6(F.stddev_samp("price"), "std", 4), F.min("price").alias("min"), F.max("price").alias("max"))


@query("SELECT v.vec_id, v.label, CASE WHEN v.vec_id % 3 = 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) ELSE 0 END AS first FROM embeddings v")
def assemble_parts(spark, d):
    """Encoded parts joined to all work: rows never encoded have a zero vector."""
    e = table(spark, d, "embeddings")
    parts = e.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return S.assemble(e.select("vec_id", "label"), parts, "vec_id", "v", 64).select("vec_id", "label", r6(F.col("v")[0], "first"))
