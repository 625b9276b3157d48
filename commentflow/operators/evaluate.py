"""Metrics and per-comment outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.functions.scores import floored_ratio, outcome_type
from commentflow.functions.text import text_sample


def with_prediction(scores: DataFrame, threshold: Column | float, score: str = "score") -> DataFrame:
    return scores.withColumn("yhat", (F.col(score) >= threshold).cast("int"))


def binary_metrics(pred: DataFrame, by: Sequence[str] = ("split",), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy per split."""
    def cell(a: int, b: int) -> Column:
        return F.count_if((F.col(y) == a) & (F.col(yhat) == b))

    counts = pred.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    rated = counts.withColumns({
        "precision": floored_ratio(tp, tp + fp),
        "recall": floored_ratio(tp, tp + fn),
        "accuracy": floored_ratio(tp + tn, tp + tn + fp + fn),
    })
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", floored_ratio(2 * p * r, p + r)).select(
        *by, "precision", "recall", "f1", "accuracy", "tp", "fp", "fn", "tn"
    )


def confusion_matrix(pred: DataFrame, by: Sequence[str] = ("split",), y: str = "y", yhat: str = "yhat") -> DataFrame:
    return pred.groupBy(*by, y, yhat).agg(F.count(F.lit(1)).alias("n"))


def macro_metrics(pred: DataFrame, positive, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: accuracy, macro precision/recall/F1 over the classes seen, and
    the same for one class against the rest. 0/0 counts as 0."""
    cells = pred.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Each cell feeds its true and its predicted class.
    sides = F.when(F.col("y") == F.col("yhat"), F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                 F.lit(0).cast("bigint").alias("fn")))
    ).otherwise(F.array(
        F.struct(F.col("y").alias("c"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("fn")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    ))
    per_class = cells.select(F.inline(sides)).groupBy("c").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    rated = per_class.select(
        "c",
        "tp",
        (tp + fn).alias("support"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero).alias("p"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero).alias("r"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(zero).alias("f"),
    )
    one = F.col("c") == positive
    return rated.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
        F.coalesce(F.max(F.when(one, F.col("p"))), zero).alias("security_precision"),
        F.coalesce(F.max(F.when(one, F.col("r"))), zero).alias("security_recall"),
        F.coalesce(F.max(F.when(one, F.col("f"))), zero).alias("security_f1"),
    )


def outcome_rows(pred: DataFrame, keep: Sequence[str] = ("id", "context_id"), text: str | None = None) -> DataFrame:
    """One row per comment for the prediction dump."""
    sample = [text_sample(F.col(text)).alias("sample_text")] if text else []
    return pred.select(
        *keep,
        F.col("score").alias("score_security"),
        F.col("yhat").alias("y_pred_security"),
        F.col("y").alias("y_true_security"),
        outcome_type(F.col("y"), F.col("yhat")).alias("type"),
        *sample,
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
