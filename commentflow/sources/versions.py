"""Small tables that a job replaces on every run, kept as versions.

A version is written beside the earlier ones and counts once its only file is in place,
so a driver that dies at any moment leaves the last good version to the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentflow.sources.sinks import landed_or_none


def _latest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    table = landed_or_none(spark, path)
    if table is None:
        return None, -1
    return table, table.agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest version (or a given one); None where there is none yet."""
    table, last = _latest(spark, path)
    return None if table is None else table.filter(F.col("version") == (last if version is None else version)).drop("version")


def write_version(rows: DataFrame, path: str) -> int:
    """Write ``rows``, which may come from the newest version, as the next one.

    One file, so that it appears at once: for tables of one row per source or so. No
    rows leave no version.
    """
    _, last = _latest(rows.sparkSession, path)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={last + 1}")
    return last + 1
