"""Streamed in several drops, the rows and the state equal the batch result."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql.types import StructType

from commentflow.operators import pooling, select, state
from commentflow.plans import queries as catalog
from commentflow.streaming import ingest

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "id string, repo string, is_pr boolean, issue_number int, comment_type string, "
    "created_at timestamp, container_updated_at timestamp, context_id string, text string"
)


def rows(start, n):
    return [
        (f"c{i}", f"r{i % 3}", False, i % 5, "issue_comment", T0 + timedelta(hours=i), T0, f"x{i % 5}", f"w{i % 4} z")
        for i in range(start, start + n)
    ]


def land(spark, path, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def dirs(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "progress", "state")}


def run(spark, dirs, transform=None, max_files=None):
    stream = ingest.stream_files(spark, dirs["in"], StructType.fromDDL(SCHEMA), max_files=max_files)
    query = ingest.start_ingest(
        ingest.dedupe_stream(stream), dirs["out"], dirs["progress"], dirs["state"], transform=transform
    )
    query.awaitTermination()


def result(spark, dirs):
    return sorted(r.id for r in spark.read.parquet(dirs["out"]).collect())


def states(df):
    return {r.source: (r.newest_ts, r.oldest_ts) for r in df.collect()}


def commits(progress):
    return sorted(f.name for f in Path(progress, "commits").iterdir() if f.name.isdigit())


def test_drops_equal_batch(spark, dirs):
    land(spark, dirs["in"], rows(0, 20))
    land(spark, dirs["in"], rows(10, 20))
    run(spark, dirs, max_files=1)
    land(spark, dirs["in"], rows(5, 40) + rows(40, 10))
    run(spark, dirs)
    run(spark, dirs)
    everything = spark.createDataFrame(rows(0, 50), SCHEMA)
    assert result(spark, dirs) == sorted(r.id for r in everything.collect())
    assert states(ingest.read_state(spark, dirs["state"])) == states(state.source_state(everything))


def test_late_copy_is_caught_by_the_sink(spark, dirs):
    """A copy beyond the watermark passes the stream and stops at the sink."""
    land(spark, dirs["in"], rows(0, 5))
    run(spark, dirs)
    land(spark, dirs["in"], rows(24 * 60, 1))
    run(spark, dirs)
    land(spark, dirs["in"], [(*rows(2, 1)[0][:5], T0 + timedelta(days=90), *rows(2, 1)[0][6:])])
    run(spark, dirs)
    assert result(spark, dirs) == sorted(["c0", "c1", "c2", "c3", "c4", "c1440"])


def test_batch_can_run_again(spark, dirs):
    first = spark.createDataFrame(rows(0, 6), SCHEMA)
    second = spark.createDataFrame(rows(3, 6), SCHEMA)
    for batch, df in ((0, first), (1, second), (1, second)):
        written = ingest.append_batch(df, batch, dirs["out"])
        ingest.update_state(written, batch, dirs["state"])
    assert result(spark, dirs) == [f"c{i}" for i in range(9)]
    whole = state.source_state(first.union(second))
    assert states(ingest.read_state(spark, dirs["state"])) == states(whole)


def test_selection_and_scoring_per_batch(spark, dirs):
    land(spark, dirs["in"], rows(0, 30))
    run(spark, dirs, ingest.selection(2, "newest", budget=3))
    batch = spark.createDataFrame(rows(0, 30), SCHEMA)
    expected = select.source_budget(select.select_per_item(batch, 2, "newest"), 3)
    assert result(spark, dirs) == sorted(r.id for r in expected.collect())

    class Letter:
        def load(self):
            return lambda texts: np.array([[0.0, float(t[1])] for t in texts])

    score = ingest.scoring(pooling.pandas_logits(Letter()), ["other", "security"], 0.9)
    other = {**dirs, "out": dirs["out"] + "2", "progress": dirs["progress"] + "2"}
    stream = spark.readStream.schema(SCHEMA).parquet(other["in"])
    ingest.start_ingest(stream, other["out"], other["progress"], transform=score).awaitTermination()
    bands = spark.read.parquet(other["out"]).groupBy("band").count().collect()
    assert sum(r["count"] for r in bands) == 30 and {r.band for r in bands} >= {"high", "low"}


def test_streaming_aggregate(spark, dirs):
    land(spark, dirs["in"], rows(0, 12))
    stream = spark.readStream.schema(SCHEMA).parquet(dirs["in"])
    query = (
        ingest.stream_source_state(stream).writeStream.outputMode("update").format("memory")
        .queryName("source_state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    expected = state.source_state(spark.createDataFrame(rows(0, 12), SCHEMA))
    assert states(spark.table("source_state").select("*")) == states(expected)
    assert ingest.read_state(spark, dirs["state"]) is None


def test_new_rows_of_old_times_are_kept(spark, dirs):
    """Unseen ids count whenever they were written; only seen ones are dropped."""
    def at(i, when):
        row = rows(i, 1)[0]
        return (*row[:5], when, *row[6:])

    land(spark, dirs["in"], [at(1, datetime(2024, 1, 30)), at(2, datetime(2024, 1, 31))])
    run(spark, dirs)
    land(spark, dirs["in"], [
        at(3, datetime(2023, 6, 1)), at(4, datetime(2023, 6, 2)), at(5, datetime(2024, 2, 1)), at(1, datetime(2023, 1, 1)),
    ])
    run(spark, dirs)
    assert result(spark, dirs) == ["c1", "c2", "c3", "c4", "c5"]
    newest, oldest = states(ingest.read_state(spark, dirs["state"]))["r0"]
    assert oldest == datetime(2023, 6, 1)


def test_scoring_with_a_state(spark, dirs):
    class Letter:
        def load(self):
            return lambda texts: np.array([[0.0, float(t[1])] for t in texts])

    land(spark, dirs["in"], rows(0, 12))
    run(spark, dirs, ingest.scoring(pooling.pandas_logits(Letter()), ["other", "security"], 0.9))
    expected = state.source_state(spark.createDataFrame(rows(0, 12), SCHEMA))
    assert states(ingest.read_state(spark, dirs["state"])) == states(expected)
    assert spark.read.parquet(dirs["out"]).count() == 12


def test_batches_run_adaptively_and_only_with_data(spark, dirs):
    """The small steps of a batch do not run one task per state partition, and no batch
    without data follows to move the watermark."""
    key, seen = "spark.sql.streaming.noDataMicroBatches.enabled", []

    def note(batch):
        seen.append(batch.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return batch

    before = spark.conf.get(key)
    for start in (0, 10):
        land(spark, dirs["in"], rows(start, 20))
        run(spark, dirs, note)
    assert seen == ["true", "true"] and spark.conf.get(key) == before
    assert commits(dirs["progress"]) == ["0", "1"]
    assert result(spark, dirs) == sorted(f"c{i}" for i in range(30))


def test_plain_batch_that_runs_again(spark, dirs):
    """Without a choice or transform what is written is what the state reads."""
    batches = [spark.createDataFrame(rows(a, 20) + rows(a, 3), SCHEMA) for a in (0, 10)]
    for n in (0, 1, 1):
        fresh = ingest.append_batch(batches[n], n, dirs["out"])
        assert sorted(r.id for r in fresh.collect()) == sorted(f"c{i}" for i in range(20 * n, 20 + 10 * n))
    assert result(spark, dirs) == sorted(f"c{i}" for i in range(30))
    assert ingest.append_batch(batches[0], 2, dirs["out"]).isEmpty()


@pytest.mark.parametrize("name", ["stream_ingest", "stream_state"])
def test_a_drop_is_one_batch_whatever_its_files(spark, tmp_path, monkeypatch, name):
    """More files of a drop, as a larger table lands them, do not make more batches."""
    events = [(i, T0 + timedelta(hours=6 * i), i % 7, "click", 1.0, "{}") for i in range(120)]
    df = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "stage_path", lambda spark, name: f"{tmp_path}/run")
    monkeypatch.setattr(catalog, "_drops", lambda events, drops=catalog._drops: [d.repartition(2) for d in drops(events)])
    found = catalog.queries()[name](spark, str(tmp_path))
    assert found.count() == (120 if name == "stream_ingest" else 7)
    assert commits(f"{tmp_path}/run/progress") == ["0", "1", "2", "3"]
