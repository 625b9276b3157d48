"""A weighted multinomial classifier whose result does not depend on the order of rows.

Sums of floating-point numbers change with their order, so a model fitted twice on a
cluster differs in its last digits, and a threshold with it. Here every row's share of
the gradient is rounded to a whole number of units first; whole numbers add up to the
same sum in any order, on any number of tasks. Plain full-batch steps follow.

All candidates (regularisation values) are fitted together: an axis of the arrays. Each
step is one scan, which gives every candidate's gradient from the training rows and,
from the others, the counts for its class F1. A task sends one row of sums per number.

Rows need an array of features of one length (a constant 1 first, if a bias is wanted),
a class id from 0 and a weight. Rows with a null in any of these, or an array of another
length, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentflow.session import stage

UNIT = float(1 << 30)  # of a gradient
_SLICE = 4096  # rows worked on at a time


@dataclass
class GridFit:
    regs: list[float]
    weights: np.ndarray  # candidate, feature, class
    f1: list[float]  # of the class asked for, on the dev rows
    chosen: int
    curve: list[list[float]]  # F1 of every candidate before each step and after the last

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (candidate, reg, f1, chosen)."""
        rows = [(c, r, f, c == self.chosen) for c, (r, f) in enumerate(zip(self.regs, self.f1, strict=True))]
        return spark.createDataFrame(rows, "candidate long, reg double, f1 double, chosen boolean")

    def coefficients(self, spark: SparkSession, candidate: int | None = None) -> DataFrame:
        """Rows (feature, class_id, value) of the chosen or the given candidate."""
        w = self.weights[self.chosen if candidate is None else candidate]
        rows = [(f, k, float(w[f, k])) for f in range(w.shape[0]) for k in range(w.shape[1])]
        return spark.createDataFrame(rows, "feature long, class_id long, value double")

    def logits(self, features: Column) -> Column:
        """The chosen model's logits of an array of features, in compiled expressions."""
        w = self.weights[self.chosen]

        def one(k: int) -> Column:
            table = F.array(*[F.lit(float(x)) for x in w[:, k]])
            return F.aggregate(F.zip_with(features, table, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

        return F.array(*[one(k) for k in range(w.shape[1])])


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Class probabilities (row, candidate, class). Sums run feature by feature, so a
    row's value does not depend on the rows beside it, as a matrix product's may."""
    z = np.zeros((len(x), w.shape[0], w.shape[2]))
    for f in range(x.shape[1]):
        z += x[:, f, None, None] * w[None, :, f, :]
    e = np.exp(z - z.max(axis=2, keepdims=True))
    total = np.zeros(z.shape[:2])
    for k in range(z.shape[2]):
        total += e[:, :, k]
    return e / total[:, :, None]


def _sums(narrow: DataFrame, w: np.ndarray, focus: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums in units (candidate, feature, class) and (candidate, tp/fp/fn)."""
    shared = narrow.sparkSession.sparkContext.broadcast(w)  # candidates x features x classes numbers
    n_c, n_f, n_k = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        grad = np.zeros((n_c, n_f, n_k), np.int64)
        counts = np.zeros((n_c, 3), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_f)
                y, weight = batch.column("y").to_numpy(), batch.column("w").to_numpy()
                dev = batch.column("dev").to_numpy(zero_copy_only=False)
                p = probabilities(x, w)
                hit, true = p.argmax(axis=2) == focus, (y == focus)[:, None]
                for k, share in enumerate((hit & true, hit & ~true, ~hit & true)):
                    counts[:, k] += share[dev].sum(axis=0)
                error = p[~dev]
                error[np.arange(len(error)), :, y[~dev]] -= 1
                error *= (weight[~dev] * UNIT)[:, None, None]
                for f in range(n_f):
                    grad[:, f, :] += np.rint(error * x[~dev, f, None, None]).astype(np.int64).sum(axis=0)
        both = np.concatenate([grad.ravel(), counts.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["at", "v"])

    found = narrow.mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(n_c * n_f * n_k + 3 * n_c)
    for r in found:
        out[r["at"]] = float(r["v"])
    cut = n_c * n_f * n_k
    return out[:cut].reshape(n_c, n_f, n_k), out[cut:].reshape(n_c, 3)


def _f1(counts: np.ndarray) -> list[float]:
    return [float(2 * tp / (2 * tp + fp + fn)) if tp + fp + fn else 0.0 for tp, fp, fn in counts]


def first_best(f1: Sequence[float], patience: int) -> int:
    """The best candidate in order; after ``patience`` without a better one the rest is not considered."""
    best = 0
    for c, value in enumerate(f1):
        if value > f1[best]:
            best = c
        elif c - best >= patience:
            break
    return best


def fit_grid(
    rows: DataFrame, regs: Sequence[float], n_classes: int, n_features: int, focus: int, dev: Column,
    features: str = "features", label: str = "label_id", weight: str = "weight",
    steps: int = 20, rate: float = 1.0, patience: int = 2,
) -> GridFit:
    """Fit every regularisation value at once; choose by F1 of the class ``focus`` on the
    rows where ``dev`` holds. The first feature is the bias, which is not regularised."""
    x = F.col(features).cast("array<double>")
    narrow = stage(
        rows.select(
            x.alias("x"), F.col(label).cast("long").alias("y"), F.col(weight).cast("double").alias("w"),
            F.coalesce(dev, F.lit(False)).alias("dev"),
        ).filter(
            (F.size("x") == n_features) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
            & F.col("y").between(0, n_classes - 1) & F.col("w").isNotNull()
        ),
        "fit",
    )
    total = narrow.filter("NOT dev").agg(F.sum(F.round(F.col("w") * UNIT).cast("decimal(38,0)"))).first()[0]
    scale = float(total or 0) or UNIT
    w = np.zeros((len(regs), n_features, n_classes))
    shrink = np.array(regs)[:, None, None] * np.ones((1, n_features, 1))
    shrink[:, 0, :] = 0
    curve = []
    for step in range(steps + 1):
        grad, counts = _sums(narrow, w, focus)
        curve.append(_f1(counts))
        if step < steps:
            w = w - rate * (grad / scale + shrink * w)
    return GridFit(list(regs), w, curve[-1], first_best(curve[-1], patience), curve)
