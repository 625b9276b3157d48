from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from commentflow.functions import timecols as tc
from commentflow.operators import filters

NOW = datetime(2024, 2, 1)
TEN = "one two three four five six seven eight nine ten"


def test_noise(spark):
    rows = [
        ("dependabot[bot]", TEN), ("renovate-x", TEN), ("k8s-ci-robot", TEN), ("abbot", TEN),
        ("GitHub-Actions", TEN), (None, TEN), ("me", TEN.rsplit(" ", 1)[0]), ("me", TEN), ("me", None),
        ("me", TEN + " THIS ISSUE IS CURRENTLY AWAITING TRIAGE now"),
        ("robotnik", TEN),
    ]
    df = spark.createDataFrame(rows, "comment_author string, text string")
    got = [r[0] for r in df.select(filters.is_noise(F.col("comment_author"), F.col("text"))).collect()]
    assert got == [True, True, True, True, True, False, True, False, True, True, False]
    assert filters.drop_noise(df).count() == 3


def test_empty_and_policy(spark):
    df = spark.createDataFrame(
        [("a", "issue_body"), (" \u00a0", "pr_body"), (None, "issue_comment"), ("b", "review_comment")],
        "text string, comment_type string",
    )
    assert [r.text for r in filters.drop_empty_text(df).collect()] == ["a", "b"]
    assert filters.body_policy(df, "bodies", nonblank_bodies=True).count() == 1
    assert filters.body_policy(df, "comments").count() == 2
    assert filters.body_policy(df, "both").count() == 4
    with pytest.raises(ValueError):
        filters.body_policy(df, "none")


def bounds(spark, mode, newest=None, oldest=None, **options):
    df = spark.createDataFrame([(newest, oldest)], "n timestamp, o timestamp")
    for name in ("since", "until"):
        if name in options:
            options[name] = tc.instant(options[name])
    low, high = tc.window_bounds(mode, tc.instant(NOW), F.col("n"), F.col("o"), **options)
    return df.select(low, high).first()[:]


DAY, SEC = timedelta(days=1), timedelta(seconds=1)
SEEN = datetime(2024, 1, 10)


@pytest.mark.parametrize(
    "mode, options, expected",
    [
        ("days", {}, (NOW - 365 * DAY, NOW)),
        ("days", {"days": 0}, (NOW, NOW)),
        ("newer", {"days": 0}, (NOW - 365 * DAY, NOW)),
        ("newer", {"newest": SEEN, "until": SEEN + DAY}, (SEEN + SEC, SEEN + DAY)),
        ("older", {"days": 0}, (NOW, NOW)),
        ("older", {"oldest": SEEN, "days": 3}, (SEEN - SEC - 3 * DAY, SEEN - SEC)),
        ("older", {"oldest": SEEN, "days": -1}, (SEEN - 2 * SEC, SEEN - SEC)),
        ("range", {"from_days": 30, "to_days": 7}, (NOW - 30 * DAY, NOW - 7 * DAY)),
        ("window", {"since": SEEN}, (SEEN, NOW)),
        ("window", {"until": SEEN, "days": 2}, (SEEN - 2 * DAY, SEEN)),
        ("window", {"since": NOW + DAY}, (NOW - SEC, NOW)),
    ],
)
def test_bounds(spark, mode, options, expected):
    assert bounds(spark, mode, **options) == expected


@pytest.mark.parametrize("mode, options", [("range", {"from_days": 1, "to_days": 2}), ("range", {}), ("x", {})])
def test_bad_bounds(spark, mode, options):
    with pytest.raises(ValueError):
        bounds(spark, mode, **options)


def test_window_with_state(spark):
    rows = [("a", SEEN), ("a", SEEN + DAY), ("b", SEEN), ("b", NOW + DAY)]
    df = spark.createDataFrame(rows, "repo string, created_at timestamp")
    state = spark.createDataFrame([("a", SEEN, SEEN)], "source string, newest_ts timestamp, oldest_ts timestamp")
    kept = filters.in_window(df, "newer", NOW, state)
    assert sorted(kept.collect()) == [("a", SEEN + DAY), ("b", SEEN)]
    assert filters.in_window(df, "newer", NOW).count() == 3


def test_backfill(spark):
    rows = [("a", SEEN + i * DAY) for i in range(4)] + [("b", SEEN)]
    df = spark.createDataFrame(rows, "subreddit string, submission_created_utc timestamp")
    state = spark.createDataFrame([("a", SEEN + 2 * DAY)], "source string, oldest_ts timestamp")
    kept = filters.backfill(df, state, SEEN + SEC)
    assert kept.collect() == [("a", SEEN + DAY)]
    done = spark.createDataFrame([("a", SEEN)], "source string, oldest_ts timestamp")
    assert filters.backfill(df, done, SEEN).collect() == [("b", SEEN)]


def test_time_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = filters.since(orders, "o_orderdate", "1998-01-01 00:00:00").select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("ts", "created_at")
    text = filters.in_window(events, "days", NOW, days=3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text


def test_dates(spark):
    values = ["2024-01-02T03:04:05Z", "1704067200", "99999999999999", "junk", None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(tc.epoch_or_iso(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 1), None, None, None]
    one = df.limit(1).select(tc.iso(tc.parse_ts(F.col("t"))), tc.epoch(tc.parse_ts(F.col("t")))).first()
    assert one[:] == ("2024-01-02T03:04:05Z", 1704164645)


def test_state_bounds_reach_the_scan(spark):
    """The widest bounds of the state test the time before the join."""
    from commentflow.plans import queries

    plan = queries.queries()["window_filter"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Join"):]
    assert ">= scalar-subquery" in below


def _scan_rows(df):
    """Rows that the Parquet scans of a finished query put out."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_state_bounds_prune_the_scan(spark, tmp_path):
    """Row groups before the oldest bound of any source are not read."""
    start = datetime(2024, 1, 1)
    path = str(tmp_path / "rows")
    rows = spark.range(200_000).select(
        F.col("id"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("created_at"),
    )
    rows.coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(path)
    newest = start + timedelta(minutes=1_900_000)
    state = spark.createDataFrame([(f"r{i}", newest, newest) for i in range(3)], "source string, newest_ts timestamp, oldest_ts timestamp")
    now = start + timedelta(minutes=2_000_000)
    got = filters.in_window(spark.read.parquet(path), "newer", now, state)
    found = got.collect()
    assert {r.id for r in found} >= set(range(190_001, 200_000)) and min(r.id for r in found) >= 189_999
    assert len(found) <= _scan_rows(got) < 60_000
