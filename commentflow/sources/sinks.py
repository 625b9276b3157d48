"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from commentflow.functions.labels import join_labels
from commentflow.operators.ordered import running_sums
from commentflow.operators.state import dedupe, unseen
from commentflow.session import stage


# Without these the CSV writer trims the texts.
_CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_splits(split_rows: DataFrame, path: str, created: str = "created_at", tie: str = "id") -> None:
    """One folder per split, rows in time order within each file.

    Ranges of (split, time, id) keep files of a split apart and in order
    without putting a split, or a much repeated time, into one task.
    """
    order = ["split", created, *([tie] if tie in split_rows.columns else [])]
    ordered = split_rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").partitionBy("split").parquet(path)


CLUSTER_BITS = 16  # of the place of a source and of a time in the interleaved key


def _spread(place: Column) -> Column:
    """The 16 bits of a number with a zero bit after each."""
    out = place.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def clustered(df: DataFrame, source: str = "repo", created: str = "created_at", tie: str = "id") -> DataFrame:
    """Rows ordered by the interleaved bits of their source's rank and their time.

    Rows near each other agree in both, so files and row groups cover a small span of
    sources *and* of times, and bounds on either, or a source's own bounds, skip most of
    them. The rank of a source is its place among all rows, so a hot source spans many
    ranks' worth of files and rare ones share one; times are ranked by their place
    between the first and the last. Nulls come first.
    """
    most = (1 << CLUSTER_BITS) - 1
    counts = df.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, [F.col("_source").asc_nulls_first()], {"_upto": "_n"}, {"_all": "_upto"})
    # The place of a source is a share of all rows; one row per source, joined by Spark's size check.
    places = stage(
        ranked.select("_source", F.floor((F.col("_upto") - F.col("_n")) / F.col("_all") * most).alias("_place")), "places"
    )
    seconds = F.col(created).cast("timestamp").cast("double")
    span = df.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).first()
    wide = max((span.high or 0.0) - (span.low or 0.0), 1.0)
    when = F.coalesce(F.floor((seconds - F.lit(span.low or 0.0)) / wide * most), F.lit(0))
    keyed = df.join(places, F.col(source).eqNullSafe(F.col("_source"))).withColumn(
        "_key", F.shiftleft(_spread(F.col("_place")), 1).bitwiseOR(_spread(when))
    )
    order = ["_key", *([tie] if tie in df.columns else [])]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns)


def write_clustered(
    df: DataFrame, path: str, source: str = "repo", created: str = "created_at", row_group: int = 32 << 20, **columns: str
) -> None:
    """Write a table that is read by source and time; small row groups skip better."""
    clustered(df, source, created, **columns).write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)


def write_windows(windows: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_meta(meta: DataFrame, path: str) -> None:
    """A one-row record as JSON."""
    meta.coalesce(1).write.mode("overwrite").json(path)


def write_scores(scores: DataFrame, path: str, score: str = "score", y: str = "y") -> None:
    """(score, y) for drawing the curves again."""
    scores.select(F.col(score).alias("score"), F.col(y).alias("y")).write.mode("overwrite").parquet(path)


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """Per-comment predictions as CSV."""
    outcomes.write.mode("overwrite").options(**_CSV).csv(path)


def write_comment_csv(rows: DataFrame, path: str, columns: Sequence[str], header: bool = True) -> None:
    """Comment CSV; label arrays are joined with ``;``."""
    kinds = dict(rows.dtypes)
    cells = [
        join_labels(F.col(c)).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns
    ]
    rows.select(*cells).write.mode("append").options(**{**_CSV, "header": header}).csv(path)


def landed_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """What an append target already holds; None when it does not exist yet. With a
    schema no file is opened to find one."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_unseen(rows: DataFrame, path: str, id_col: str = "id", partition_by: Sequence[str] = ()) -> None:
    """Append the rows whose id the target does not hold; a second run adds none."""
    landed = landed_or_none(rows.sparkSession, path)
    fresh = dedupe(rows, id_col)
    if landed is not None:
        fresh = unseen(stage(fresh, "incoming"), landed, id_col, staged=True)
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)
