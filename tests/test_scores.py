import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from commentflow.functions import scores as sc
from commentflow.operators import calibrate, evaluate, pooling

LABELS = ["bug", "other", "security"]


def test_softmax_and_argmax(spark):
    values = [[1.0, 2.0, 3.0], [1000.0, 1000.0, -1000.0], [-5.0, 0.0, 0.0]]
    df = spark.createDataFrame([(v,) for v in values], "l array<double>")
    for (v, p, best) in df.select("l", sc.softmax(F.col("l")), sc.argmax(F.col("l"))).collect():
        e = np.exp(np.array(v) - max(v))
        assert p == pytest.approx(list(e / e.sum()))
        assert best == int(np.argmax(v))
    probs = df.select(sc.class_probs(sc.softmax(F.col("l")), LABELS).alias("m")).first().m
    assert set(probs) == set(LABELS)


def test_pooling(spark):
    chunks = spark.createDataFrame(
        [("a", "c", 0, [0.0, 0.0, 2.0], 0), ("a", "c", 1, [0.0, 0.0, 2.0], 1), ("a", "c", 2, [0.0, 0.0, 1.0], 0), ("a", "d", 0, [0.0, 0.0, 0.0], 0)],
        "id string, context_id string, window_no int, logits array<double>, y int",
    )
    p = pooling.chunk_probability(chunks, 2)
    pooled = {(r.id, r.context_id): (r.score, r.y) for r in pooling.max_pool(p).collect()}
    top = math.exp(2) / (2 + math.exp(2))
    assert pooled[("a", "c")] == (pytest.approx(top), 1)
    assert pooled[("a", "d")] == (pytest.approx(1 / 3), 0)
    best = {r.context_id: r.window_no for r in pooling.best_window(p).collect()}
    assert best == {"c": 0, "d": 0}


def curve_by_hand(points):
    """Precision and recall of every distinct threshold, counted directly."""
    total = sum(y for _, y in points)
    out = {}
    for threshold in {s for s, _ in points}:
        tp = sum(y for s, y in points if s >= threshold)
        n = sum(1 for s, _ in points if s >= threshold)
        out[threshold] = (tp / n, tp / total if total else 0.0)
    return out


CASES = {
    "ties": [(0.9, 1), (0.9, 0), (0.8, 1), (0.1, 0)],
    "reached": [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0)],
    "all positive": [(0.9, 1), (0.2, 1)],
    "no positive": [(0.9, 0), (0.2, 0)],
    "fallback": [(0.9, 0), (0.8, 1), (0.7, 1), (0.6, 0)],
}


@pytest.mark.parametrize("name", [*CASES, "random"])
def test_calibration(spark, name):
    rng = random.Random(3)
    points = CASES.get(name) or [
        (round(s, 2), int(rng.random() < s)) for s in (rng.random() for _ in range(400))
    ]
    df = spark.createDataFrame(points, "score double, y int")
    curve = calibrate.pr_curve(df)
    expected = curve_by_hand(points)
    got = {r.score: (pytest.approx(r.precision), pytest.approx(r.recall)) for r in curve.collect()}
    assert expected == got
    reached = {t: pr for t, pr in expected.items() if pr[0] >= 0.95}
    if reached:
        best = max(reached, key=lambda t: (reached[t][1], t))
    else:
        best = max(expected, key=lambda t: (expected[t][0], t))
    row = calibrate.calibrate_threshold(curve).first()
    assert row.threshold == best and row.target_precision == 0.95
    # The stored precision is that of the decision taken with the threshold.
    metrics = evaluate.binary_metrics(evaluate.with_prediction(df, row.threshold), by=()).first()
    assert metrics.precision == pytest.approx(row.precision_at_threshold)
    assert metrics.recall == pytest.approx(row.recall_at_threshold)


def test_histogram(spark):
    rng = random.Random(5)
    points = [(rng.random(), 1) for _ in range(300)] + [(0.25, 0)] * 4
    df = spark.createDataFrame(points, "score double, y int")
    got = {(r.y, r.bin): r.n for r in calibrate.score_histogram(df).collect()}
    for y in (0, 1):
        counts, _ = np.histogram([s for s, k in points if k == y], bins=30)
        assert [got.get((y, b), 0) for b in range(30)] == list(counts)


def test_macro_metrics(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 3), (2, 2), (2, 2), (0, 2)]
    df = spark.createDataFrame(pairs, "y int, yhat int")
    m = evaluate.macro_metrics(df, 2).first()
    classes = sorted({c for p in pairs for c in p})
    ps, rs, fs = [], [], []
    for c in classes:
        tp = sum(1 for a, b in pairs if a == b == c)
        pred, true = sum(1 for _, b in pairs if b == c), sum(1 for a, _ in pairs if a == c)
        ps.append(tp / pred if pred else 0)
        rs.append(tp / true if true else 0)
        fs.append(2 * tp / (pred + true) if pred + true else 0)
    assert m.accuracy == pytest.approx(4 / 7)
    assert (m.macro_precision, m.macro_recall, m.macro_f1) == pytest.approx(
        (sum(ps) / 4, sum(rs) / 4, sum(fs) / 4)
    )
    assert (m.security_precision, m.security_recall, m.security_f1) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert evaluate.macro_metrics(df, 9).first().security_f1 == 0


def test_metrics_and_outcomes(spark):
    rows = [("t", 0.9, 1), ("t", 0.8, 0), ("t", 0.1, 1), ("t", 0.2, 0), ("v", 0.1, 0)]
    df = spark.createDataFrame([(str(i), "c", *r) for i, r in enumerate(rows)], "id string, context_id string, split string, score double, y int")
    pred = evaluate.with_prediction(df, 0.5)
    m = {r.split: r for r in evaluate.binary_metrics(pred).collect()}
    assert (m["t"].precision, m["t"].recall, m["t"].f1, m["t"].accuracy) == (0.5, 0.5, 0.5, 0.5)
    assert (m["v"].precision, m["v"].recall, m["v"].f1, m["v"].accuracy) == (0, 0, 0, 1)
    out = evaluate.outcome_rows(pred)
    assert [r.type for r in out.orderBy("id").collect()] == ["TP", "FP", "FN", "TN", "TN"]
    assert {r.type: r.n for r in evaluate.outcome_counts(out).collect()} == {"TP": 1, "FP": 1, "FN": 1, "TN": 2}
    assert evaluate.confusion_matrix(pred).count() == 5


class FirstLetter:
    """Logits from a window's first word."""

    def load(self):
        def predict(texts):
            return np.array([[0.0, 0.0, float(t.split()[0][1:])] for t in texts])

        return predict


def test_scoring(spark):
    texts = [("", "1"), (None, "2"), ("w2 x", "3"), (" ".join(f"w{9 - i % 6}" for i in range(22)), "4"), ("w0", None)]
    df = spark.createDataFrame(texts, "text string, id string").withColumn("context_id", F.lit(None).cast("string"))
    out = pooling.score_comments(
        df, pooling.pandas_logits(FirstLetter()), LABELS, 0.5, version={"model": "m"},
        max_len=12, overlap=4, special=2,
    )
    rows = {r.id: r for r in out.collect()}
    for i in ("1", "2"):
        empty = rows[i]
        assert (empty.score_security, empty.is_security, empty.band, empty.best_snippet) == (0, False, "low", "")
        assert empty.class_probs == {}
    e = math.exp(2)
    assert rows["3"].score_security == pytest.approx(e / (2 + e)) and rows["3"].band == "high"
    # All three windows of the long text score the same: the first is shown.
    assert rows["4"].best_snippet == texts[3][0][:len("w9 ") * 10 - 1]
    assert rows["4"].class_probs["security"] == pytest.approx(rows["4"].score_security)
    assert rows[None].band == "low" and rows[None].version == {"model": "m"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


class Split:
    def load(self):
        return str.split


class Lengths:
    def load(self):
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])


class Short:
    def load(self):
        return lambda texts: np.zeros((len(texts) - 1, 2))


def test_plugins_get_slices_of_bounded_text(spark):
    """Rows of any number and size: the answers of all, and few of them as Python objects."""
    texts = [None, "", "a b", "w " * 700_000, *[f"t{i} " * (i % 400) for i in range(3000)], None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    words = df.select("id", "text", pooling.pandas_tokenize(Split())(F.col("text")).alias("words"))
    got = {r.id: r for r in words.select("id", F.size("words").alias("n"), F.get("words", F.lit(0)).alias("w")).collect()}
    assert {i: (got[i].n, got[i].w) for i in got} == {
        i: (len((t or "").split()), next(iter((t or "").split()), None)) for i, t in enumerate(texts)
    }
    lists = words.withColumn("words", F.when(F.col("id") % 7 != 0, F.col("words")))
    logits = lists.select("id", "words", pooling.pandas_logits(Lengths(), 5)(F.col("words")).alias("x"))
    for r in logits.filter("id <> 3").collect():
        assert r.x == [[float(len(w)), 1.0] for w in r.words or []]
    assert logits.filter("id = 3").select(F.size("x")).first()[0] == 700_000
    with pytest.raises(PythonException, match="logits of shape"):
        lists.select(pooling.pandas_logits(Short())(F.col("words"))).collect()


def test_plugin_output_comes_slice_by_slice():
    rows = pa.array([None, "abc", "", "x" * (3 * pooling.SLICE_BYTES), *["y" * 1000] * 5000])
    size = pooling._numbers(pc.binary_length(rows))
    parts = list(pooling._slices(rows, size))
    assert pa.concat_arrays(parts).equals(rows)
    assert all(len(p) == 1 or pc.sum(pc.binary_length(p)).as_py() < 2 * pooling.SLICE_BYTES for p in parts[2:])
    assert not list(pooling._slices(rows[:0], size[:0]))

    class Noting(Split):
        seen = []

        def load(self):
            return lambda text: self.seen.append(len(text)) or text.split()

    tokenizer, texts = Noting(), pa.array(["w " * 500] * 10_000)
    answers = pooling.pandas_tokenize(tokenizer).func(iter([texts]))
    first = next(answers)
    assert len(first) == len(tokenizer.seen) and sum(tokenizer.seen) <= pooling.SLICE_BYTES
    assert len(first) + sum(map(len, answers)) == len(texts)


def test_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.46,), (0.44,)], "s double")
    assert [r[0] for r in df.select(sc.triage_band(F.col("s"), 0.5)).collect()] == ["high", "mid", "low"]
