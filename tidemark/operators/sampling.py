"""Exact seeded samples by hashed key: the same rows at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def stratified(df: DataFrame, strata: list[str], size: Column | int, seed: int, key: str) -> DataFrame:
    """Exactly ``size`` rows of each stratum, or all it has."""
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(*hash_order(seed, key)))
    return df.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r")


def hashed(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(*hash_order(seed, key)).limit(n)


def audit_sheet(df: DataFrame, key: str, strata: list[str], size: int, seed: int, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """A blind sheet (audit_id and shown columns) and the key that tells its rows, sampled by strata."""
    drawn = stratified(df, strata, size, seed, key)
    numbered = drawn.withColumn("audit_id", F.row_number().over(W.orderBy(*hash_order(seed + 1, key))))
    return numbered.select("audit_id", *shown), numbered.select("audit_id", key, *strata)
