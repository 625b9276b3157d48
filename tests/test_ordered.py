"""Ranks and sums over a global order, with hot values, against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from commentflow.operators import ordered, select, split


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows share one key and one value."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        hot = i % 3 == 0
        data.append(("hot" if hot else f"k{rng.randrange(40)}", 5 if hot else rng.randrange(20), i))
    data.append((None, 1, 3000))
    data.append((None, 0, 3001))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, v int, id long").repartition(7).cache()


def grouped(data, key, order):
    groups = defaultdict(list)
    for row in data:
        groups[key(row)].append(row)
    return {k: sorted(v, key=order) for k, v in groups.items()}


def test_global_rank(spark, rows):
    data, df = rows
    got = ordered.global_rank(df, [F.col("v").asc(), F.col("id").asc()], "r", "n")
    expected = {row[2]: i for i, row in enumerate(sorted(data, key=lambda x: (x[1], x[2])))}
    found = {r.id: r.r for r in got.collect()}
    assert found == expected
    assert {r.n for r in got.select("n").distinct().collect()} == {len(data)}


def test_global_rank_of_nothing(spark, rows):
    assert ordered.global_rank(rows[1].filter("id < 0"), [F.col("id").asc()]).count() == 0


def test_running_sums(spark, rows):
    data, df = rows
    got = ordered.running_sums(df, [F.col("v").desc(), F.col("id").asc()], {"s": "v"}, {"t": "s"})
    total, expected = 0, {}
    for row in sorted(data, key=lambda x: (-x[1], x[2])):
        total += row[1]
        expected[row[2]] = total
    assert {r.id: r.s for r in got.collect()} == expected
    assert got.select("t").distinct().collect() == [(total,)]


def test_group_rank(spark, rows):
    data, df = rows
    got = ordered.group_rank(df, ["k"], [F.col("v").asc(), F.col("id").asc()], "r")
    expected = {
        row[2]: i
        for members in grouped(data, lambda x: x[0], lambda x: (x[1], x[2])).values()
        for i, row in enumerate(members)
    }
    assert {r.id: r.r for r in got.collect()} == expected


@pytest.mark.parametrize("k", [0, 1, 8, 9, 100, 1001, None])
def test_top_k(spark, rows, k):
    """Direct, salted and fully ranked selection give the same rows."""
    data, df = rows
    got = select.top_k(df, ["k"], [F.col("v").desc(), F.col("id").asc()], k, rank="r")
    expected = {
        (row[2], i + 1)
        for members in grouped(data, lambda x: x[0], lambda x: (-x[1], x[2])).values()
        for i, row in enumerate(members[:k])
    }
    assert {(r.id, r.r) for r in got.collect()} == expected


def test_plans_hold_no_single_task_over_rows(spark, rows):
    _, df = rows
    ranked = ordered.global_rank(df, [F.col("v").asc(), F.col("id").asc()])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # The only single-partition step runs over one row per partition, which
    # an aggregate has made.
    after = plan.split("SinglePartition", 1)[1]
    assert after.lstrip(", ").startswith("ENSURE") and "HashAggregate" in after.splitlines()[1]
    assert plan.count("SinglePartition") == 1
    grouped_plan = ordered.group_rank(df, ["k"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in grouped_plan
    top = select.top_k(df, ["k"], [F.col("id").asc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert top.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("n, train, dev", [(1, 0, 0), (3, 2, 0), (10, 7, 1), (90, 62, 13)])
def test_split_sizes(spark, n, train, dev):
    start = datetime(2024, 1, 1)
    rows = [(f"t{i:03d}", start + timedelta(days=i // 2), j) for i in range(n) for j in range(2)]
    rows.append((None, start, 9))
    df = spark.createDataFrame(rows, "context_id string, created_at timestamp, j int")
    got = split.thread_split(df)
    threads = {r.context_id: r.split for r in got.collect()}
    names = [threads[f"t{i:03d}"] for i in range(n)]
    assert names == ["train"] * train + ["dev"] * dev + ["test"] * (n - train - dev)
    assert got.count() == 2 * n
    assert {r.split: r.n_rows for r in split.split_counts(got).collect()} == {
        s: 2 * names.count(s) for s in set(names)
    }


def test_split_is_by_thread_and_in_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = split.thread_split(docs, thread="o_custkey", created="o_orderdate")
    assert got.count() == docs.count()
    assert got.select("o_custkey", "split").distinct().count() == docs.select("o_custkey").distinct().count()
    first = got.groupBy("o_custkey", "split").agg(F.min("o_orderdate").alias("t"))
    edge = {r.split: (r.lo, r.hi) for r in first.groupBy("split").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert edge["train"][1] <= edge["dev"][0] and edge["dev"][1] <= edge["test"][0]
    with pytest.raises(ValueError):
        split.assign_threads(docs, (0.5, 0.2, 0.2))
