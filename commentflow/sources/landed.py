"""An index of landed ids, so that an append does not read all earlier ids.

Ids are hashed into ``buckets``. Per bucket a bitmap says which hash slots are in use
(``marks``: words of 64 bits, made by ``bit_or``), and the ids themselves lie in folders
per bucket (``ids``). A lookup reads the marks of the buckets its rows fall into; only
rows whose bit is set may be landed, and only their buckets' ids are read to decide.
New ids, the usual case, set few bits by chance, so an append reads little more than
its own rows' marks. The answer is exact.

Every append has a number and replaces its own folders, and a lookup reads only those
of earlier appends: what is run again finds and leaves the same. ``compact`` merges the
folders of many appends into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentflow.operators.state import dedupe
from commentflow.session import stage
from commentflow.sources.sinks import landed_or_none

SLOT_BITS = 26  # hash slots of a bucket: 2 to this power
_SCHEMAS = {
    "ids": "id string, low int, high int, bucket int",
    "marks": "word int, mask long, low int, high int, bucket int",
}


@dataclass(frozen=True)
class LandedIndex:
    path: str
    buckets: int = 256

    def _placed(self, rows: DataFrame, id_col: str) -> DataFrame:
        """Rows (id, bucket, word, mask) of the ids, each once."""
        h = F.xxhash64(F.col(id_col).cast("string"))
        ids = rows.select(F.col(id_col).cast("string").alias("id"), h.alias("h")).filter("id IS NOT NULL").distinct()
        slot = F.shiftrightunsigned("h", 64 - SLOT_BITS)
        return ids.select(
            "id", F.pmod("h", F.lit(self.buckets)).cast("int").alias("bucket"),
            F.shiftright(slot, 6).cast("int").alias("word"),
            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - SLOT_BITS}) & 63 AS int))").alias("mask"),
        )

    def _read(self, spark: SparkSession, part: str, buckets: list[int], before: int | None) -> DataFrame | None:
        """Marks or ids of the named buckets: other folders are not opened."""
        table = landed_or_none(spark, f"{self.path}/{part}", _SCHEMAS[part])
        if table is None:
            return None
        spans = _current(self.spans(spark), before)
        wanted = F.lit(False)
        for low, high in spans:
            wanted = wanted | ((F.col("low") == low) & (F.col("high") == high))
        return table.filter(F.col("bucket").isin(buckets) & wanted)

    def spans(self, spark: SparkSession) -> list[tuple[int, int]]:
        """The appends that each finished folder holds, first and last number."""
        done = landed_or_none(spark, f"{self.path}/done")
        return [] if done is None else sorted((r.low, r.high) for r in done.select("low", "high").distinct().collect())

    def next_append(self, spark: SparkSession) -> int:
        """A number above those of all finished appends."""
        return max((high for _, high in self.spans(spark)), default=-1) + 1

    def landed(self, rows: DataFrame, id_col: str = "id", before: int | None = None) -> DataFrame | None:
        """The ids (column ``id``, as text) of the rows that are landed; None: no id is."""
        spark = rows.sparkSession
        if not _current(self.spans(spark), before):
            return None
        placed = stage(self._placed(rows, id_col), "lookup")
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # at most ``buckets``
        marks = self._read(spark, "marks", touched, before)
        if marks is None:
            return None
        used = marks.select("bucket", "word", F.col("mask").alias("used")).withColumnRenamed("bucket", "b").withColumnRenamed("word", "w")
        hit = (F.col("bucket") == F.col("b")) & (F.col("word") == F.col("w")) & (F.col("mask").bitwiseAND(F.col("used")) != 0)
        maybe = stage(placed.join(used, hit, "left_semi").select("id", "bucket"), "lookup")
        suspect = [r.bucket for r in maybe.select("bucket").distinct().collect()]
        if not suspect:
            return None
        known = self._read(spark, "ids", suspect, before)
        return maybe.select("id").join(known.select("id"), "id", "left_semi")

    def unseen(self, rows: DataFrame, id_col: str = "id", before: int | None = None) -> DataFrame:
        """The rows whose id is not landed; a null id never is."""
        found = self.landed(rows, id_col, before)
        if found is None:
            return rows
        known = found.select(F.col("id").alias("_landed"))
        return rows.join(known, F.col(id_col).cast("string") == F.col("_landed"), "left_anti")

    def add(self, rows: DataFrame, number: int, id_col: str = "id") -> None:
        """Enter the ids of an append. Nothing counts before its mark in ``done`` is written."""
        self._write(stage(self._placed(rows, id_col), "enter"), number, number)

    def _write(self, placed: DataFrame, low: int, high: int) -> None:
        # One file per bucket at most; a bucket's share of an append is bounded by 1 / buckets of it.
        spread = F.pmod("bucket", F.lit(self.buckets))
        span = f"low={low}/high={high}"
        placed.select("bucket", "id").repartition(spread).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/{span}")
        marks = placed.groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
        marks.repartition(spread).sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/marks/{span}"
        )
        placed.sparkSession.range(1).write.mode("overwrite").parquet(f"{self.path}/done/{span}")

    def compact(self, spark: SparkSession) -> None:
        """Merge the folders of all appends into one; lookups use it from then on."""
        spans = _current(self.spans(spark), None)
        if len(spans) > 1:
            ids = self._read(spark, "ids", list(range(self.buckets)), None)
            self._write(stage(self._placed(ids, "id"), "enter"), spans[0][0], spans[-1][1])


def _current(spans: list[tuple[int, int]], before: int | None) -> list[tuple[int, int]]:
    """Of overlapping folders the widest, among those with earlier appends only."""
    past = [s for s in spans if before is None or s[1] < before]
    return [s for s in past if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in past)]


def append_indexed(rows: DataFrame, path: str, index: LandedIndex, id_col: str = "id") -> DataFrame:
    """Append the rows whose id is not landed as ``path/batch_id=<n>``; gives those rows.

    The number counts finished appends, and the index is written last: a run that
    died in between is replaced by the next one.
    """
    spark = rows.sparkSession
    number = index.next_append(spark)
    fresh = stage(index.unseen(stage(dedupe(rows, id_col), "incoming"), id_col, number), "fresh")
    fresh.write.mode("overwrite").parquet(f"{path}/batch_id={number}")
    index.add(fresh, number, id_col)
    return fresh
