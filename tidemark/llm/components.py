"""Connected components of a link table by distributed union-find with contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _least(node):
    return F.struct(F.xxhash64(node).alias("order"), node.alias("id"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (id, component) for every id in ``links``; component is the smallest id reachable.

    Each round hooks every node to the neighbour of least hashed order (a random
    priority, so that long chains shrink by a constant factor too) and replaces
    links by links between parents. No group is gathered: neighbours meet in a
    partial minimum, and hubs meet in joins that adaptive execution can split.
    Rounds are written to the shared folder. Null ends and self links are ignored;
    an empty table gives an empty result.
    """
    edges = materialize(
        links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b").distinct(),
        "links",
    )
    parents: list[DataFrame] = []
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(
            both.groupBy(F.col("a").alias("id"))
            .agg(F.min(_least(F.col("b"))).alias("m"))
            .select("id", F.least(_least(F.col("id")), F.col("m"))["id"].alias("parent")),
            "parents",
        )
        parents.append(parent)
        left = parent.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        fewer = materialize(
            edges.join(left, "a").join(right, "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where("a < b").distinct(),
            "links",
        )
        drop_table(edges)
        edges = fewer
    if not parents:
        return links.sparkSession.createDataFrame([], "id long, component long")
    nodes = parents[0]
    for later in parents[1:]:
        step = later.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        nodes = nodes.join(step, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"))
    nodes = materialize(nodes, "roots")
    for table in parents:
        drop_table(table)
    roots = nodes.groupBy("parent").agg(F.min("id").alias("component"))
    return nodes.join(roots, "parent").select("id", "component")
