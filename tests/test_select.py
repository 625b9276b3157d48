from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from commentflow.functions.scores import reaction_sum
from commentflow.operators import select, state

T0 = datetime(2024, 1, 1)


def comments(spark, rows):
    """(id, repo, is_pr, number, type, minute, updated minute, reactions)"""
    data = [
        (i, repo, pr, n, kind, T0 + timedelta(minutes=m), T0 + timedelta(minutes=u), r, f"{repo}#{n}")
        for i, repo, pr, n, kind, m, u, r in rows
    ]
    return spark.createDataFrame(
        data,
        "id string, repo string, is_pr boolean, issue_number int, comment_type string, "
        "created_at timestamp, container_updated_at timestamp, reactions int, context_id string",
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_policies(spark):
    df = comments(spark, [
        ("a", "r", False, 1, "issue_comment", 1, 9, 5),
        ("b", "r", False, 1, "issue_comment", 2, 9, 7),
        ("c", "r", False, 1, "issue_comment", 3, 9, 7),
        ("d", "r", False, 1, "issue_comment", 3, 9, 0),
    ])
    assert ids(select.select_per_item(df, 2, "oldest")) == ["a", "b"]
    assert ids(select.select_per_item(df, 2, "newest")) == ["c", "d"]
    assert ids(select.select_per_item(df, 2, "most-reacted")) == ["b", "c"]
    assert ids(select.select_per_item(df, 1, "nonsense")) == ["a"]
    assert ids(select.select_per_item(df, 0)) == []
    assert ids(select.select_per_item(df, None)) == ["a", "b", "c", "d"]


def test_budget(spark):
    df = comments(spark, [
        ("body1", "r", False, 1, "issue_body", 0, 5, 0),
        ("i1", "r", False, 1, "issue_comment", 1, 5, 0),
        ("i2", "r", False, 2, "issue_comment", 1, 8, 0),
        ("i3", "r", False, 2, "issue_comment", 2, 8, 0),
        ("p1", "r", True, 3, "issue_comment", 1, 9, 0),
        ("bodyp", "r", True, 3, "pr_body", 1, 9, 0),
        ("s1", "s", False, 1, "issue_comment", 1, 1, 0),
    ])
    bodies = ["body1", "bodyp"]
    assert ids(select.source_budget(df, 0)) == bodies
    assert ids(select.source_budget(df, 2)) == sorted(bodies + ["i2", "i3", "s1"])
    assert ids(select.source_budget(df, 3)) == sorted(bodies + ["i1", "i2", "i3", "s1"])
    for budget in (50, 5000, None):
        assert ids(select.source_budget(df, budget)) == ids(df)


def test_thread_order(spark):
    df = comments(spark, [
        ("c2", "r", False, 1, "issue_comment", 1, 5, 0),
        ("c1", "r", False, 1, "issue_comment", 1, 5, 0),
        ("b", "r", False, 1, "issue_body", 9, 5, 0),
        ("x", "r", False, 2, "issue_comment", 0, 5, 0),
    ])
    got = {r.id: r.position for r in select.thread_order(df).collect()}
    assert got == {"b": 1, "c1": 2, "c2": 3, "x": 1}
    assert [r.id for r in select.sort_threads(df).collect()] == ["b", "c1", "c2", "x"]


def test_by_score(spark):
    rows = [
        ("a", "t3_p", "fine", 5), ("b", "t3_p", " [removed] ", 9), ("c", "t1_x", "fine", 9),
        ("d", "t3_p", "fine", 7), ("e", "t3_p", "fine", 7), ("f", "t3_p", None, 1),
    ]
    df = spark.createDataFrame([(*r, "p") for r in rows], "id string, parent_id string, text string, score int, context_id string")
    assert ids(select.select_by_score(df, 2)) == ["d", "e"]
    assert ids(select.select_by_score(df, None)) == ["a", "d", "e", "f"]


def test_reactions(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (1, array(named_struct('content', 'A', 'users', named_struct('totalCount', 3L)),
                named_struct('content', 'B', 'users', CAST(NULL AS STRUCT<totalCount: BIGINT>)))),
      (2, CAST(NULL AS ARRAY<STRUCT<content: STRING, users: STRUCT<totalCount: BIGINT>>>)) AS t(id, g)""")
    assert [r[0] for r in df.orderBy("id").select(reaction_sum(F.col("g"))).collect()] == [3, 0]


def test_dedupe_and_state(spark):
    rows = [("a", 1, "second"), ("a", 0, "first"), (None, 0, "n1"), (None, 1, "n2"), ("b", 1, "only")]
    df = spark.createDataFrame(rows, "id string, src_ord int, text string")
    assert sorted(r.text for r in state.dedupe(df).collect()) == ["first", "n1", "n2", "only"]
    landed = spark.createDataFrame([("b",)], "id string")
    assert sorted(r.text for r in state.unseen(state.dedupe(df), landed).collect()) == ["first", "n1"]
    seen = spark.createDataFrame([("r", T0), ("r", T0 + timedelta(1)), ("s", T0)], "repo string, created_at timestamp")
    old = spark.createDataFrame(
        [("r", T0 + timedelta(5), T0), ("q", T0, T0)], "source string, newest_ts timestamp, oldest_ts timestamp"
    )
    got = {r.source: (r.newest_ts, r.oldest_ts) for r in state.source_state(seen, old).collect()}
    assert got == {"r": (T0 + timedelta(5), T0), "s": (T0, T0), "q": (T0, T0)}


def test_rows_without_an_id(spark):
    """Equal content is one row, whatever input it came from; types without room are refused."""
    rows = [(None, 0, "same"), (None, 1, "same"), (None, 1, "other"), (7, 0, "same"), (7, 1, "late")]
    for kind in ("string", "bigint"):
        df = spark.createDataFrame(rows, "id bigint, src_ord int, text string").withColumn("id", F.col("id").cast(kind))
        got = state.dedupe(df)
        assert dict(got.dtypes)["id"] == kind
        assert sorted(r.text for r in got.collect()) == ["other", "same", "same"]
    df = spark.createDataFrame(rows, "id int, src_ord int, text string")
    assert [r.text for r in state.dedupe(df.filter("id = 7")).collect()] == ["same"]
    with pytest.raises(Exception, match="cast it to string or bigint"):
        state.dedupe(df).collect()
