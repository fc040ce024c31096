"""Near-duplicate clustering of titles: exact address, anchored title windows, SimHash bands; earliest row is the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X

#: Bits that may differ, seconds of the window, characters of a shingle.
MOST_BITS, WINDOW_S, SHINGLE = 6, 48 * 3600, 4
BANDS = max(4, MOST_BITS + 1)
BAND_BITS = 64 // BANDS


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Character k-grams; a shorter text is one, an empty one none."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k))))


def hash_halves(shingle: Column) -> tuple[Column, Column]:
    """64 bits of the shingle's md5 as two unsigned 32-bit halves."""
    own = F.md5(shingle)
    half = lambda a: F.conv(F.substring(own, a, 8), 16, 10).cast("long")
    return half(1), half(9)


def simhash(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, fp): bit set where more shingles have it than not; repeats count, an empty text has 0.

    Shingles are counted by key with a partial aggregation of 64 sums, so nothing but
    one row a key is shuffled.
    """
    s = df.select(key, F.explode_outer(shingles(text)).alias("s")).withColumns(dict(zip(("hi", "lo"), hash_halves(F.col("s")), strict=True)))
    votes = [F.sum(F.when(F.shiftrightunsigned(F.col(h), b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"{h}{b}") for h in ("hi", "lo") for b in range(32)]
    summed = s.groupBy(key).agg(F.count("s").alias("n"), *votes)
    bits = [F.when((F.col("n") > 0) & (F.col(f"{h}{b}") > 0), F.shiftleft(F.lit(1).cast("long"), b + (32 if h == "hi" else 0))).otherwise(F.lit(0).cast("long")) for h in ("hi", "lo") for b in range(32)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return summed.select(key, out.alias("fp"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(fp: Column) -> Column:
    """Array of (band, value): two fingerprints within MOST_BITS share one, as there are more bands than bits."""
    own = lambda i: F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fp, i * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).alias("value"))
    return F.array(*[own(i) for i in range(BANDS)])


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the shared folder that the session names, else by caching (local runs)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def url_edges(df: DataFrame) -> DataFrame:
    """Each row with the earliest row of its canonical address, at any distance in time.

    A minimum and a join, so that a very common address is pre-aggregated and its rows
    can be split over tasks.
    """
    own = df.where("canon <> ''")
    first = own.groupBy("canon").agg(F.min(F.struct("t", "id")).alias("first"))
    return own.join(first, "canon").select("id", F.col("first.id").alias("root")).where("id <> root")


def _windows(df: DataFrame, window_s: int) -> DataFrame:
    """(norm, at, root): the anchors of each title that occurs more than once; ``df`` has norm, t, id.

    The fold runs over a title's distinct times, not its rows: these come from a grid of
    file stamps, however common the title.
    """
    times = df.groupBy("norm", "t").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    many = times.groupBy("norm").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("t")).alias("times")).where("n > 1")
    start = F.struct(F.lit(None).cast("long").alias("t"), F.array().cast("array<bigint>").alias("out"))

    def step(a, t):
        new = a["t"].isNull() | (t - a["t"] > window_s)
        return F.struct(F.when(new, t).otherwise(a["t"]).alias("t"), F.when(new, F.concat(a["out"], F.array(t))).otherwise(a["out"]).alias("out"))

    anchors = many.select("norm", F.explode(F.aggregate("times", start, step, lambda a: a["out"])).alias("at"))
    return anchors.join(times.select("norm", F.col("t").alias("at"), F.col("first").alias("root")), ["norm", "at"])


def title_edges(df: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Rows of one title with the anchor of their window.

    The first row is an anchor; a row more than the window after the anchor is the next
    one: anchored windows, not gaps. Rows meet anchors by title and time slot, two slots
    an anchor, so a common title is many keys.
    """
    own = df.where("norm <> ''").select("norm", "t", "id")
    slot = lambda t: F.floor(t / window_s)
    anchors = _windows(own, window_s).withColumn("slot", F.explode(F.array(slot(F.col("at")), slot(F.col("at")) + 1)))
    met = own.withColumn("slot", slot(F.col("t"))).join(anchors, ["norm", "slot"]).where((F.col("t") >= F.col("at")) & (F.col("t") - F.col("at") <= window_s))
    # the windows of a title do not overlap, so a row meets one anchor
    return met.select("id", "root").where("id <> root")


def near_pairs(df: DataFrame, window_s: int = WINDOW_S, most: int = MOST_BITS) -> DataFrame:
    """Pairs (id, root) within the window and ``most`` bits, the earlier row as root; rows: id, t, fp.

    Candidates share a band value and a time bucket of one window's length, so a value's
    rows of all time never meet: the later row is looked up in its own bucket and the
    one before.
    """
    b = df.select("id", "t", "fp", F.floor(F.col("t") / window_s).alias("slot"), F.inline(bands(F.col("fp"))))
    early = b.select("band", "value", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"), F.col("id").alias("root"), F.col("t").alias("t0"), F.col("fp").alias("fp0"))
    joined = b.join(early, ["band", "value", "slot"]).where((F.struct("t0", "root") < F.struct("t", "id")) & (F.col("t") - F.col("t0") <= window_s) & (hamming(F.col("fp"), F.col("fp0")) <= most))
    return joined.select("id", "root").distinct()


def linking_pairs(df: DataFrame, window_s: int = WINDOW_S, most: int = MOST_BITS) -> DataFrame:
    """Pairs (id, root) that connect the same rows as :func:`near_pairs` does, of rows id, t, fp.

    Rows of one fingerprint and slot lie within the window of one another, so each is
    linked to the earliest, and fingerprints of a slot meet once. Two of neighbouring
    slots are linked where the last row of one and the first of the other are near.
    """
    slot = F.floor(F.col("t") / window_s)
    keyed = df.select("id", "t", "fp", slot.alias("slot"))
    kinds = cut(keyed.groupBy("fp", "slot").agg(F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("last")).select("fp", "slot", F.col("first.id").alias("root"), F.col("first.t").alias("t"), "last"))
    within = keyed.join(kinds.select("fp", "slot", "root"), ["fp", "slot"]).select("id", "root").where("id <> root")
    b = kinds.select("root", "t", "fp", "slot", F.inline(bands(F.col("fp"))))
    early = kinds.select("last", F.col("root").alias("other"), F.col("fp").alias("fp0"), F.col("slot").alias("slot0"), F.inline(bands(F.col("fp"))))
    early = early.withColumn("slot", F.explode(F.array(F.col("slot0"), F.col("slot0") + 1)))
    met = b.join(early, ["band", "value", "slot"]).where((F.col("root") != F.col("other")) & (hamming(F.col("fp"), F.col("fp0")) <= most) & ((F.col("slot0") == F.col("slot")) | (F.col("t") - F.col("last") <= window_s)))
    return within.union(met.select(F.col("root").alias("id"), F.col("other").alias("root")).distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable over undirected edges (id, root), for every id of ``nodes``.

    Each round every node hooks to its neighbour of least hashed order, and edges are
    replaced by edges of parents, until none is left: edges shrink by a constant factor a
    round, long chains too, and hubs meet in partial minima and joins that can be split.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("order"), F.col(c).alias("id"))
    left = cut(edges.select(F.least("id", "root").alias("a"), F.greatest("id", "root").alias("b")).where("a < b").distinct())
    rounds = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["id"].alias("parent"))
        rounds.append(cut(hooked))
        up = lambda c: rounds[-1].select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
        left = cut(left.join(up("a"), "a").join(up("b"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
    if not rounds:
        return nodes.select("id", F.col("id").alias("root"))
    top = rounds[0]
    for later in rounds[1:]:
        top = top.join(later.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
    least = top.groupBy("parent").agg(F.min("node").alias("least"))
    found = top.join(least, "parent").select(F.col("node").alias("id"), "least")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("least", "id").alias("root"))


def deduplicate(df: DataFrame, key: str, title: str, url: str, seen: str, window_s: int = WINDOW_S, most: int = MOST_BITS) -> DataFrame:
    """Add cluster_id, is_duplicate and dup_count (on every member) to articles; the earliest row of a cluster is its root.

    Every row comes back once, rows with null or repeated keys too. Rows are numbered by
    time and key, so that the least number is the earliest row; rows without a time come
    last and are linked by address alone. Equal rows are interchangeable.
    """
    t = D.epoch(F.col(seen))
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), t.alias("t"), X.normal_title(F.col(title)).alias("norm"), X.canonical_url(F.col(url)).alias("canon"), F.col(key).alias("key"))
    # a number in time order without a global sort's single task: ranked within hours after hours are counted
    hour = base.withColumn("hour", F.floor(F.col("t") / 3600))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.asc_nulls_last("hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = hour.groupBy("hour").agg(F.count("*").alias("n")).select(F.col("hour").alias("at"), before.alias("start"))
    own = F.row_number().over(W.partitionBy("hour").orderBy("t", "key", F.xxhash64(F.to_json("row"))))
    rows = cut(hour.withColumn("own", own).join(starts, F.col("hour").eqNullSafe(F.col("at"))).select("row", "t", "norm", "canon", "key", (F.col("start") + F.col("own")).cast("long").alias("id")))
    timed = rows.where("t is not null and norm <> ''")
    prints = simhash(timed, "id", F.col("norm")).join(timed.select("id", "t"), "id")
    late = F.coalesce("t", F.lit((1 << 62)))
    edges = url_edges(rows.withColumn("t", late)).union(title_edges(timed, window_s)).union(linking_pairs(prints, window_s, most))
    found = cut(components(rows, edges))
    size = found.groupBy("root").agg(F.count("*").alias("dup_count"))
    roots = size.join(rows.select(F.col("id").alias("root"), F.col("key").alias("cluster_id")), "root")
    out = rows.join(found, "id").join(roots, "root")
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns], "cluster_id", (F.col("id") != F.col("root")).alias("is_duplicate"), "dup_count")


def top_syndicated(df: DataFrame, n: int, key: str) -> DataFrame:
    """Roots with most copies."""
    return df.where("NOT is_duplicate").orderBy(F.desc("dup_count"), key).limit(n)
