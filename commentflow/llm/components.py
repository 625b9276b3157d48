"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (reduced map-side) joined back to the edges,
so a node with very many neighbours is split like any skewed join key. Edges are
staged in the shared folder after each round; the driver only sees two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("_low"))
    low = F.least("a", "_low")
    near = both.join(lowest, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), low.alias("b"))
    else:
        out = near.filter("b < a").select(F.col("b").alias("a"), low.alias("b")).union(
            lowest.select("a", low.alias("b"))
        )
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns ``a`` and ``b``; the result has one row per
    node of an edge: ``node`` and ``component``, its component's smallest node.

    Null ends and loops are ignored; repeated edges count once; no edges, no rows.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first())

    now = stage(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = state(now)
    while seen[0]:
        now = stage(_star(_star(now, True), False), "edges")
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
