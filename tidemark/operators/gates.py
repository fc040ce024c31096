"""Gates that flag rows; nothing is deleted until a consumer filters on ``keep``."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def suffixes(domain: Column) -> Column:
    """A domain and the domains above it: a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def belongs(domain: Column, names: Iterable[str]) -> Column:
    """Whether a domain is one of the names or below one."""
    return F.arrays_overlap(suffixes(domain), F.array(*[F.lit(n) for n in sorted(names)]))


def blocked(domain: Column, patterns: Iterable[str]) -> Column:
    """Patterns with a star match the whole domain, others any part of it."""
    tests = [domain.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$") if "*" in p else domain.contains(p) for p in patterns]
    return reduce(or_, tests, F.lit(False))


def passes_source(hard: bool = False) -> Column:
    open_ = ~F.col("is_blocked_domain")
    return open_ & (F.col("source_tier") <= 2) if hard else open_


def source_gate(df: DataFrame, tiers: Mapping[int, Iterable[str]], state: Iterable[str], block: Iterable[str], hard: bool = False) -> DataFrame:
    """Add source_tier (the first that fits, else 3), is_state_affiliated, is_blocked_domain and pass_source."""
    domain = F.lower(F.coalesce("domain", F.lit("")))
    tier = reduce(lambda c, k: F.when(belongs(domain, tiers[k]), k).otherwise(c), sorted(tiers, reverse=True), F.lit(3))
    out = df.withColumns({"source_tier": tier, "is_state_affiliated": belongs(domain, state), "is_blocked_domain": blocked(domain, block)})
    return out.withColumn("pass_source", passes_source(hard))


def materiality(df: DataFrame, any_of: Iterable[str]) -> DataFrame:
    """pass_materiality: any of the named conditions (columns has_...); without one every row passes."""
    found = [F.col(f"has_{c}") for c in any_of if f"has_{c}" in df.columns]
    return df.withColumn("pass_materiality", reduce(or_, found) if found else F.lit(True))


def funnel(df: DataFrame) -> DataFrame:
    duplicate = F.coalesce("is_duplicate", F.lit(False)) if "is_duplicate" in df.columns else F.lit(False)
    return df.withColumn("keep", F.col("pass_source") & F.col("pass_materiality") & ~duplicate)


def period(df: DataFrame, date: str, start: str, end: str, stride: int = 1) -> DataFrame:
    """Rows of every ``stride``-th day of a period with both ends."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.where(F.col(date).between(first, last) & (F.datediff(F.col(date), first) % stride == 0))


def attrition(df: DataFrame) -> DataFrame:
    """Rows that survive each stage and those it removes: one pass over the flags."""
    counts = df.agg(
        F.count("*").alias("raw"), F.count_if("pass_source").alias("src"), F.count_if(F.col("pass_source") & F.col("pass_materiality")).alias("mat"), F.count_if("keep").alias("kept")
    )
    zero = F.lit(0).cast("long")
    rows = [("0 raw", "raw", zero), ("1 source", "src", F.expr("raw - src")), ("2 materiality", "mat", F.expr("src - mat")), ("3 dedup", "kept", F.expr("mat - kept"))]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("n"), r.alias("removed")) for s, c, r in rows])))


def balance(df: DataFrame, key: str) -> DataFrame:
    """Raw and kept rows by key, retention and shares of the totals in percent."""
    out = df.groupBy(key).agg(F.count("*").alias("n_raw"), F.count_if("keep").alias("n_kept"))
    total = lambda c: F.sum(c).over(W.partitionBy())  # noqa: E731  a row a key
    return out.withColumns(
        {"retention_pct": 100 * F.col("n_kept") / F.col("n_raw"), "share_raw_pct": 100 * F.col("n_raw") / total("n_raw"), "share_kept_pct": F.try_divide(100 * F.col("n_kept"), total("n_kept"))}
    )
