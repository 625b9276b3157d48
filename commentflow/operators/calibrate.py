"""Precision/recall curve, threshold at a target precision, score histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.constants import HISTOGRAM_BINS, TARGET_PRECISION
from commentflow.functions.scores import floored_ratio
from commentflow.operators.ordered import running_sums


def pr_curve(scores: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(score, tp, fp, precision, recall) per distinct score.

    Equal scores are one point, so the precision of a point is that of
    ``score >= threshold``. Scores are counted before they are ordered.
    """
    points = scores.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("_pos"),
        F.sum(1 - F.col(y).cast("bigint")).alias("_neg"),
    )
    curve = running_sums(
        points, [F.col("score").desc()], {"tp": "_pos", "fp": "_neg"}, {"_positives": "tp"}
    )
    return curve.select(
        "score",
        "tp",
        "fp",
        floored_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        floored_ratio(F.col("tp"), F.col("_positives")).alias("recall"),
    )


def calibrate_threshold(curve: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """One row: the point of highest recall among those that reach the target
    precision, else the point of highest precision; the higher score on a tie."""
    point = F.struct("score", "precision", "recall")
    best = curve.agg(
        F.max_by(
            F.when(F.col("precision") >= target, point),
            F.when(F.col("precision") >= target, F.struct("recall", "score")),
        ).alias("_reached"),
        F.max_by(point, F.struct("precision", "score")).alias("_fallback"),
    ).select(F.coalesce("_reached", "_fallback").alias("_best"))
    return best.select(
        F.col("_best.score").alias("threshold"),
        F.lit(float(target)).alias("target_precision"),
        F.col("_best.precision").alias("precision_at_threshold"),
        F.col("_best.recall").alias("recall_at_threshold"),
    )


def score_histogram(
    scores: DataFrame, score: str = "score", y: str = "y", bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """(y, bin, n): equal bins over each class's own score range.

    A class with a single score is centred in a range of width one.
    """
    points = scores.groupBy(F.col(y).alias("y"), F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    span = points.groupBy("y").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    place = F.floor((F.col("score") - lo) / width * F.lit(float(bins)))
    return (
        points.join(span, "y")
        .select("y", F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"), "_n")
        .groupBy("y", "bin")
        .agg(F.sum("_n").alias("n"))
    )
