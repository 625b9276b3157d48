"""Thread-aware temporal split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.constants import SPLIT_RATIOS
from commentflow.operators.ordered import global_rank

SPLITS = ("train", "dev", "test")


def assign_threads(
    df: DataFrame,
    ratios: Sequence[float] = SPLIT_RATIOS,
    thread: str = "context_id",
    created: str = "created_at",
) -> DataFrame:
    """(thread, first_ts, split): threads by first time, oldest to train."""
    if len(ratios) != 3 or abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("three ratios that sum to 1 are needed")
    threads = (
        df.filter(F.col(thread).isNotNull())
        .groupBy(thread)
        .agg(F.min(created).alias("first_ts"))
    )
    ranked = global_rank(threads, [F.col("first_ts").asc_nulls_last(), F.col(thread).asc()], "_rank", "_n")
    # Truncated double products, so 90 threads at 0.7 give 62.
    n_train = (F.col("_n") * F.lit(float(ratios[0]))).cast("bigint")
    n_dev = (F.col("_n") * F.lit(float(ratios[1]))).cast("bigint")
    part = (
        F.when(F.col("_rank") < n_train, "train")
        .when(F.col("_rank") < n_train + n_dev, "dev")
        .otherwise("test")
    )
    return ranked.select(thread, "first_ts", part.alias("split"))


def thread_split(
    df: DataFrame,
    ratios: Sequence[float] = SPLIT_RATIOS,
    thread: str = "context_id",
    created: str = "created_at",
) -> DataFrame:
    """Each row with the split of its thread; rows without a thread drop out.

    One join serves all three parts. A thread that holds a large share of the
    rows is split by the adaptive skew join.
    """
    assigned = assign_threads(df, ratios, thread, created).select(thread, "split")
    return df.join(assigned, thread)


def split_counts(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
