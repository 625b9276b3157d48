"""Score expressions: softmax, argmax, bands, outcome types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentflow.constants import DENOMINATOR_FLOOR, MID_BAND


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by its maximum."""
    # One-element arrays hold the maximum, the exponentials and their sum, so
    # each is found once per row.
    exps = F.transform(
        F.array(F.array_max(logits)), lambda top: F.transform(logits, lambda x: F.exp(x - top))
    )[0]
    return F.transform(
        F.array(exps),
        lambda e: F.transform(
            F.array(F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)),
            lambda total: F.transform(e, lambda x: x / total),
        )[0],
    )[0]


def argmax(values: Column) -> Column:
    """Zero-based place of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def class_probs(probs: Column, labels: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, labels)), probs)


def is_security(score: Column, threshold: Column | float) -> Column:
    return score >= threshold


def triage_band(score: Column, threshold: Column | float, mid: float = MID_BAND) -> Column:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= thr, "high").when(score >= thr - F.lit(mid), "mid").otherwise("low")


def binary_target(label: Column, positive) -> Column:
    return (label == positive).cast("int")


def outcome_type(y: Column, yhat: Column) -> Column:
    return (
        F.when((y == 1) & (yhat == 1), "TP")
        .when((y == 0) & (yhat == 1), "FP")
        .when((y == 0) & (yhat == 0), "TN")
        .when((y == 1) & (yhat == 0), "FN")
    )


def floored_ratio(num: Column, den: Column) -> Column:
    """num / den with the denominator held above zero."""
    return num / F.greatest(den.cast("double"), F.lit(DENOMINATOR_FLOOR))


def reaction_sum(groups: Column) -> Column:
    """Sum of users.totalCount over reaction groups, nulls counting as zero."""
    return F.coalesce(
        F.aggregate(
            groups,
            F.lit(0).cast("bigint"),
            lambda acc, g: acc + F.coalesce(g["users"]["totalCount"], F.lit(0).cast("bigint")),
        ),
        F.lit(0).cast("bigint"),
    )
