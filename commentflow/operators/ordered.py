"""Exact ranks and running sums over a global order, without one big task.

A Window without PARTITION BY sends every row to one task, and a Window over a
hot key sends that key to one task. Here the rows are range-partitioned on the
full order (which must end in a unique key, so that a frequent value can be
split), sorted inside each partition and staged with their partition number and
place. Only one row per partition is then needed to turn places into ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentflow.session import stage

_PART, _POS = "_ordered_part", "_ordered_place"
_PLACE_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in partition


def _stage_in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)))
    )
    return stage(placed, "ordered")


def _prefix(totals: DataFrame, names: Sequence[str], grand: bool = True) -> DataFrame:
    """Sums over earlier partitions. One row per partition, so broadcast below is bounded."""
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cols = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names]
    if grand:
        cols += [F.sum(n).over(everything).alias(f"_total_{n}") for n in names]
    return totals.select(_PART, *cols)


def global_rank(
    df: DataFrame, order: Sequence[Column], rank: str = "rank", total: str | None = None
) -> DataFrame:
    """Zero-based position of each row in the order; optionally the row count too."""
    staged = _stage_in_order(df, order)
    offsets = _prefix(staged.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")), ["n"])
    out = staged.join(F.broadcast(offsets), _PART).withColumn(
        rank, F.col("_before_n") + F.col(_POS)
    )
    if total:
        out = out.withColumn(total, F.col("_total_n"))
    return out.drop(_PART, _POS, "_before_n", "_total_n")


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], totals: dict[str, str] | None = None
) -> DataFrame:
    """Running sums over the order: ``sums`` maps output to input column.

    ``totals`` maps an output column to an entry of ``sums``: its grand total.
    """
    staged = _stage_in_order(df, order)
    names = list(sums)
    offsets = _prefix(
        staged.groupBy(_PART).agg(*[F.sum(sums[n]).alias(n) for n in names]), names
    )
    within = W.partitionBy(_PART).orderBy(_POS).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = staged
    for n in names:
        out = out.withColumn(f"_within_{n}", F.sum(sums[n]).over(within))
    out = out.join(F.broadcast(offsets), _PART)
    for n in names:
        out = out.withColumn(n, F.col(f"_within_{n}") + F.col(f"_before_{n}"))
    for name, of in (totals or {}).items():
        out = out.withColumn(name, F.col(f"_total_{of}"))
    helpers = [f"_{kind}_{n}" for n in names for kind in ("within", "before", "total")]
    return out.drop(_PART, _POS, *helpers)


def group_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """Zero-based position of each row inside its group, for groups of any size.

    A group that spans several partitions is counted piece by piece. The table
    of pieces (group and partition) is staged, so Spark knows its size: while
    it fits the broadcast threshold the rows are not shuffled again, beyond it
    they meet their piece by (partition, group), which splits a hot group.
    """
    staged = _stage_in_order(df, [*map(F.col, keys), *order])
    pieces = staged.groupBy(_PART, *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(_POS).alias("_first")
    )
    earlier = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    shifts = stage(
        pieces.select(
            F.col(_PART).alias("_piece_part"),
            shift.alias("_shift"),
            *[F.col(k).alias(f"_key_{k}") for k in keys],
        ),
        "pieces",
    )
    same_piece = F.col(_PART) == F.col("_piece_part")
    for k in keys:
        same_piece = same_piece & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = staged.join(shifts, same_piece).withColumn(rank, F.col(_POS) + F.col("_shift"))
    return out.drop(_PART, _POS, "_piece_part", "_shift", *[f"_key_{k}" for k in keys])
