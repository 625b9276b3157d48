"""Places that earlier batches took, so that limits hold for a whole run of batches.

A stream chooses comments batch by batch. The ledger counts, per item and per source,
the comments that each batch took (``deltas/batch_id=<n>``); from time to time the sums
so far are written as ``sums/batch_id=<n>``. A batch reads the newest sums before it
and the deltas since, never its own, and replaces its own files: a batch that runs
again takes the same rows and leaves the same counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentflow.operators.filters import is_body
from commentflow.operators.select import budget_order, policy_order, top_k
from commentflow.session import stage
from commentflow.sources.sinks import landed_or_none

_SCHEMA = "scope string, key string, n long, batch_id long"


@dataclass(frozen=True)
class Ledger:
    path: str
    every: int = 16  # batches between two tables of sums

    def _part(self, spark: SparkSession, name: str) -> DataFrame:
        found = landed_or_none(spark, f"{self.path}/{name}")
        if found is None:
            return spark.createDataFrame([], _SCHEMA)
        return found.select("scope", "key", "n", F.col("batch_id").cast("long").alias("batch_id"))

    def taken(self, spark: SparkSession, before: int) -> DataFrame:
        """Rows (scope, key, n): places taken by batches before ``before``."""
        sums = self._part(spark, "sums").filter(F.col("batch_id") < before)
        last = sums.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
        # Literal bounds on the folder column: older deltas and sums are not opened.
        parts = sums.filter(F.col("batch_id") == last).unionByName(
            self._part(spark, "deltas").filter((F.col("batch_id") > last) & (F.col("batch_id") < before))
        )
        return parts.groupBy("scope", "key").agg(F.sum("n").alias("n"))

    def record(self, counts: DataFrame, batch_id: int) -> None:
        """Write what a batch took: rows (scope, key, n)."""
        counts.write.mode("overwrite").parquet(f"{self.path}/deltas/batch_id={batch_id}")
        if batch_id % self.every == self.every - 1:
            sums = self.taken(counts.sparkSession, batch_id + 1)
            sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch_id={batch_id}")


def _key(columns: Sequence[str]) -> Column:
    """One text for the values of several columns, nulls told apart."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


@dataclass(frozen=True)
class LedgerSelection:
    """At most ``k`` comments per item and ``budget`` per source over all batches.

    A batch ranks its own rows by policy and takes those for which earlier batches left
    a place; bodies are free. What a later batch brings cannot replace an earlier
    choice. Rows without a place are not landed, and may be offered again.
    """

    ledger: Ledger
    k: int | None = None
    policy: str = "oldest"
    budget: int | None = None
    item: Sequence[str] = ("context_id",)
    source: str = "repo"
    updated: str = "container_updated_at"
    tie: str = "id"
    columns: dict[str, str] = field(default_factory=dict)

    def _left(self, rows: DataFrame, taken: DataFrame, scope: str, keys: Sequence[str], limit: int, order: Sequence[Column]) -> DataFrame:
        """Rows whose place, after those taken before, is within the limit."""
        ranked = top_k(rows.withColumn("_key", _key(keys)), ["_key"], order, limit, self.tie, "_place")
        # Only the counts of this batch's keys are needed, and they are few while it is small.
        used = taken.filter(F.col("scope") == scope).select(F.col("key").alias("_key"), F.col("n").alias("_taken"))
        placed = ranked.join(used, "_key", "left").filter(F.col("_place") + F.coalesce("_taken", F.lit(0)) <= limit)
        return placed.drop("_key", "_place", "_taken")

    def choose(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The batch's choice, staged; its counts are recorded by ``record``."""
        taken = stage(self.ledger.taken(rows.sparkSession, batch_id), "ledger")
        body = is_body(F.col("comment_type"))
        free, comments = rows.filter(body), rows.filter(~body | body.isNull())
        inside = policy_order(self.policy, tie=self.tie, **self.columns)
        if self.k is not None:
            comments = self._left(comments, taken, "item", self.item, self.k, inside)
        if self.budget is not None:
            order = budget_order(inside, updated=self.updated)
            comments = self._left(comments, taken, "source", [self.source], self.budget, order)
        return stage(free.unionByName(comments), "chosen")

    def record(self, chosen: DataFrame, batch_id: int) -> None:
        comments = chosen.filter(~F.coalesce(is_body(F.col("comment_type")), F.lit(False)))
        counts = [
            comments.groupBy(F.lit(scope).alias("scope"), _key(keys).alias("key")).agg(F.count(F.lit(1)).alias("n"))
            for scope, keys in (("item", self.item), ("source", [self.source]))
        ]
        self.ledger.record(counts[0].unionByName(counts[1]), batch_id)
