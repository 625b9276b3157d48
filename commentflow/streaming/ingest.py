"""Incremental ingest of landed files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from commentflow.operators.pooling import LogitsFn, score_comments
from commentflow.operators.select import select_per_item, source_budget
from commentflow.operators.state import dedupe, source_state, unseen, with_ids
from commentflow.session import stage
from commentflow.sources.landed import LandedIndex
from commentflow.sources.sinks import landed_or_none
from commentflow.streaming.ledger import LedgerSelection

Transform = Callable[[DataFrame], DataFrame]


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet",
    max_files: int | None = None, **options: str,
) -> DataFrame:
    """New files under ``path`` as a stream; ``max_files`` bounds a batch."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def dedupe_stream(stream: DataFrame, id_col: str = "id", delay: str = "7 days") -> DataFrame:
    """Drop ids that arrived before within ``delay``.

    The watermark is on the time of arrival, so no row is ever late, whatever its
    own time. Copies that arrive after ``delay``, and null ids, which a stream
    cannot tell apart, are left to the landed-id check of the sink.
    """
    named = with_ids(stream, id_col)
    timed = named.withColumn("_arrived", F.current_timestamp())
    return timed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark([id_col]).drop("_arrived")


def _before(table: DataFrame | None, batch_id: int) -> DataFrame | None:
    return None if table is None else table.filter(F.col("batch_id") < batch_id)


def append_batch(
    batch: DataFrame, batch_id: int, out: str, id_col: str = "id", transform: Transform | None = None,
    choose: LedgerSelection | None = None, index: LandedIndex | None = None, session: SparkSession | None = None,
) -> DataFrame:
    """Write a batch's unseen rows, chosen and transformed, to ``out/batch_id=<n>``; gives
    the unseen rows as they were before the choice.

    The folder is replaced and only earlier batches count as landed, so a
    batch that is run again gives the same table. The batch is staged before
    anything reads it twice. With an ``index`` of the landed ids the earlier
    batches themselves are not read.

    ``session`` does all that follows the staging. A stream's own session has no
    adaptive execution: there each small step would run as many tasks as the state has.
    """
    spark = session or batch.sparkSession
    fresh = stage(dedupe(batch, id_col), "batch", spark)
    if fresh.isEmpty():
        return fresh  # a batch of copies only, say
    if index is not None:
        fresh = index.unseen(fresh, id_col, batch_id)
    else:
        landed = _before(landed_or_none(spark, out), batch_id)
        if landed is not None:
            fresh = unseen(fresh, landed, id_col, staged=True)
    plain = choose is None and transform is None  # what is written serves as the stage then
    if not plain:
        fresh = stage(fresh, "fresh")
    chosen = fresh if choose is None else choose.choose(fresh, batch_id)
    rows = chosen if transform is None else transform(chosen)
    rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    if choose is not None:
        choose.record(chosen, batch_id)
    if index is not None:
        written = landed_or_none(spark, f"{out}/batch_id={batch_id}")
        index.add(rows.limit(0) if written is None else written, batch_id, id_col)
    return spark.read.schema(fresh.schema).parquet(f"{out}/batch_id={batch_id}") if plain else fresh


def update_state(rows: DataFrame, batch_id: int, state_path: str, source: str = "repo", created: str = "created_at") -> None:
    """Write the state after a batch as ``state_path/batch_id=<n>``."""
    previous = read_state(rows.sparkSession, state_path, before=batch_id)
    state = source_state(rows, previous, source, created)
    state.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")


def read_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The state of the latest batch (or the latest before a given one)."""
    table = landed_or_none(spark, state_path)
    if table is None:
        return None
    if before is not None:
        table = _before(table, before)
    latest = table.select(F.max("batch_id")).scalar()
    return table.filter(F.col("batch_id") == latest).drop("batch_id")


_STREAM_SETTINGS = {
    # A batch without data would only drop old ids of ``dedupe_stream``, which the next
    # batch with data does as well, and costs as much as one.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

_STARTING = Lock()  # streams of one session may be started side by side


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that a stream takes over when it starts; the session keeps its own."""
    with _STARTING:
        before = {key: spark.conf.get(key) for key in settings}
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)


def start_ingest(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    state_path: str | None = None,
    id_col: str = "id",
    source: str = "repo",
    created: str = "created_at",
    transform: Transform | None = None,
    choose: LedgerSelection | None = None,
    index: LandedIndex | None = None,
) -> StreamingQuery:
    """Append unseen rows of every file landed since the last run, then stop.

    ``checkpoint`` holds the progress; keep one per output. ``choose`` picks from each
    batch's new rows within limits that hold over all batches; ``transform`` runs on
    what is left, e.g. scoring, or a selection within the batch alone.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = append_batch(batch, batch_id, out, id_col, transform, choose, index, spark)
        if state_path and not rows.isEmpty():
            update_state(rows, batch_id, state_path, source, created)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _settings(spark, _STREAM_SETTINGS):
        return writer.start()


def selection(k: int | None, policy: str = "oldest", budget: int | None = None, item: Sequence[str] = ("context_id",)) -> Transform:
    """Choice of k comments per item within a source's budget in every batch anew; for
    limits over all batches see ``ledger.LedgerSelection``."""
    def choose(rows: DataFrame) -> DataFrame:
        return source_budget(select_per_item(rows, k, policy, item), budget)

    return choose


def scoring(logits: LogitsFn, labels: Sequence[str], threshold: float, **options) -> Transform:
    """Per-batch scoring of new comments."""
    def score(rows: DataFrame) -> DataFrame:
        return score_comments(rows, logits, labels, threshold, **options)

    return score


def stream_source_state(stream: DataFrame, source: str = "repo", created: str = "created_at") -> DataFrame:
    """Newest and oldest time per source as a streaming aggregate (update mode)."""
    return source_state(stream, None, source, created)
