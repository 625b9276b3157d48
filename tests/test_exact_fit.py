"""The same coefficients in any order, equal to a plain fit; the choice by patience."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentflow.operators import exact_fit

REGS = (0.0, 0.05, 0.5)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        y = int(rng.integers(0, 3))
        x = [1.0, float(rng.normal(y, 1)), float(rng.normal(-y, 2))]
        out.append((i, x, y, [1.0, 0.5, 2.0][y], i % 4 == 0))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, features array<double>, label_id int, weight double, dev boolean")


def fit(df, **options):
    return exact_fit.fit_grid(df, REGS, 3, 3, focus=2, dev=F.col("dev"), steps=15, **options)


def plain(rows):
    x = np.array([r[1] for r in rows])
    y, w, dev = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    x, y, w = x[~dev], y[~dev], w[~dev]
    out = []
    for reg in REGS:
        b = np.zeros((3, 3))
        for _ in range(15):
            z = x @ b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            shrink = reg * b
            shrink[0] = 0
            b = b - (x.T @ (p * w[:, None]) / w.sum() + shrink)
        out.append(b)
    return np.array(out)


def test_against_a_plain_fit(spark, rows):
    got = fit(frame(spark, rows))
    assert np.allclose(got.weights, plain(rows), atol=1e-7)
    assert len(got.curve) == 16 and got.curve[-1] == got.f1
    dev = [r for r in rows if r[4]]
    for c, b in enumerate(plain(rows)):
        said = (np.array([r[1] for r in dev]) @ b).argmax(1) == 2
        true = np.array([r[2] for r in dev]) == 2
        assert abs(got.f1[c] - 2 * (said & true).sum() / (said.sum() + true.sum())) < 1e-12


def test_any_order_gives_the_same_bits(spark, rows):
    first = fit(frame(spark, rows).repartition(7))
    again = fit(frame(spark, rows[::-1]).repartition(2, "label_id"))
    assert first.weights.tobytes() == again.weights.tobytes() and first.f1 == again.f1


def test_scoring_and_tables(spark, rows):
    got = fit(frame(spark, rows))
    scored = frame(spark, rows).select("features", got.logits(F.col("features")).alias("z")).limit(50).collect()
    for r in scored:
        assert np.allclose(r.z, np.array(r.features) @ got.weights[got.chosen])
    table = got.table(spark).collect()
    assert [r.chosen for r in sorted(table, key=lambda r: r.candidate)].index(True) == got.chosen
    assert got.coefficients(spark).count() == 9


def test_patience():
    assert exact_fit.first_best([0.1, 0.3, 0.2, 0.25, 0.9], 2) == 1
    assert exact_fit.first_best([0.1, 0.3, 0.2, 0.25, 0.9], 3) == 4
    assert exact_fit.first_best([0.5, 0.5, 0.6], 2) == 2 and exact_fit.first_best([0.0], 1) == 0


def test_odd_rows(spark, rows):
    """Nulls, other lengths and unknown classes are left out; no rows leave zeros."""
    odd = [(1, None, 0, 1.0, False), (2, [1.0, None, 2.0], 0, 1.0, False), (3, [1.0], 0, 1.0, False), (4, [1.0, 1.0, 1.0], 7, 1.0, False),
           (5, [1.0, float("nan"), 1.0], 1, 1.0, False), (6, [1.0, 1.0, 1.0], None, 1.0, False), (7, [1.0, 1.0, 1.0], 1, None, None)]
    assert fit(frame(spark, rows + odd)).weights.tobytes() == fit(frame(spark, rows)).weights.tobytes()
    none = fit(frame(spark, odd))
    assert not none.weights.any() and none.f1 == [0.0] * 3 and none.chosen == 0
