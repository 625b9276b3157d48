"""Targets and copies against plain Python."""

import math
import re
from collections import defaultdict

import pytest

from commentflow.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not full:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def rate(target, docs):
    """Rates of one source by bisection."""
    docs = [d for d in docs if d]
    if not docs or target >= 3 * sum(docs) * (1 - 1e-12):
        return lambda d: 3.0 if d else 1.0
    mean = sum(docs) / len(docs)
    lo, hi = -1e5, 1e5
    for _ in range(300):
        mid = (lo + hi) / 2
        f = sum(d * min(3.0, math.exp(min(50, mid * d / mean))) for d in docs)
        lo, hi = (mid, hi) if f < target else (lo, mid)
    return lambda d: min(3.0, math.exp(min(50, lo * d / mean))) if d else 1.0


def check(rows, got):
    sizes, docs = defaultdict(int), defaultdict(list)
    for _, text, source in rows:
        sizes[source] += size(text)
        docs[source].append(size(text))
    want = goals(sizes)
    taken = defaultdict(int)
    solved = {s: rate(want[s], docs[s]) for s in sizes}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.src] and math.isclose(r.target, want[r.src], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.rate, solved[r.src](r.size), rel_tol=1e-4, abs_tol=1e-4)
        assert math.floor(r.rate + 1e-6) <= r.copies <= math.ceil(r.rate - 1e-6) and r.taken == r.copies * r.size
        assert 0 <= r.taken <= 3 * r.size
        taken[r.src] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(60, max(docs[s], default=0))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, src string").repartition(3)
    df = df.selectExpr("*", "src AS source", "1 AS size", "2 AS target")
    return mixing.mix(df, keep=("doc_id", "src")).collect()


@pytest.fixture(scope="module")
def rows():
    out = [(i, "w " * ((i * 37) % 211), "abcdefgh"[min(7, i % 16)]) for i in range(900)]
    out += [(900, None, "a"), (901, "", "b"), (902, "x y", None), (903, None, None), (None, "a b c", "Ä"), (1, "w " * 37, "b")]
    return out + [(1000 + i, None, "empty") for i in range(3)] + [(2000, "one " * 9000, "z")]


def test_against_plain_python(spark, rows):
    check(rows, run(spark, rows))


def test_runs_agree(spark, rows):
    assert sorted(map(str, run(spark, rows))) == sorted(map(str, run(spark, rows[::-1])))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    check([tuple(r) for r in docs.collect()], mixing.mix(docs.withColumn("src", docs["source"]), keep=("doc_id", "src")).collect())


def test_empty_and_bad_weights(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(none, weights=(1, 0))
