"""Duplicates, already landed ids, and the per-source state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Each map task passes on one row per key, so a mass of copies never meets
    in one task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


# Columns that order the copies of an id, where an input has them.
_COPY_ORDER = (
    "src_ord", "created_at", "comment_created_at", "comment_created_utc", "text", "comment_body",
)


# Where a row came from is not part of what it says.
_NOT_CONTENT = ("src_ord",)


def with_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows without an id get a hash of their content, so that they are told apart
    and a second append, or another input, finds them again.

    Only a string or bigint column has room for such a hash. With another type of id
    a row without one stops the job: it could neither be told apart nor found again.
    """
    kind = df.schema[id_col].dataType.simpleString()
    content = F.to_json(F.struct(*[c for c in df.columns if c not in (id_col, *_NOT_CONTENT)] or [F.lit(None)]))
    if kind == "string":
        made = F.sha2(content, 256)
    elif kind == "bigint":
        made = F.xxhash64(content)
    else:
        made = F.raise_error(F.lit(f"a row has no {id_col}, and a {kind} cannot hold a hash: cast it to string or bigint"))
    return df.withColumn(id_col, F.coalesce(F.col(id_col), made.cast(kind)))


def dedupe(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the first row per id: input order, then time, then text. Rows without
    an id are named by their content first."""
    df = with_ids(df, id_col)
    order = [F.col(c).asc() for c in _COPY_ORDER if c in df.columns]
    return keep_first(df, [id_col], order or [F.col(id_col).asc()])


def unseen(df: DataFrame, landed: DataFrame, id_col: str = "id", staged: bool = False) -> DataFrame:
    """Rows whose id is not landed yet. Only the landed id column is read.

    ``staged``: the rows are a written table. Their size is then known, and
    the landed ids are first cut down to those that occur in it: while the
    rows fit Spark's broadcast threshold, the landed table is only scanned and
    never shuffled, however large it has grown.
    """
    known = landed.select(id_col)
    if staged:
        known = known.join(df.select(id_col), id_col, "left_semi")
    return df.join(known, id_col, "left_anti")


def source_state(
    rows: DataFrame,
    previous: DataFrame | None = None,
    source: str = "repo",
    created: str = "created_at",
) -> DataFrame:
    """Newest and oldest time per source, merged with the previous state.

    Rows are reduced in each task first, so a hot source costs nothing extra.
    """
    seen = rows.groupBy(F.col(source).alias("source")).agg(
        F.max(created).alias("newest_ts"), F.min(created).alias("oldest_ts")
    )
    if previous is None:
        return seen
    both = seen.unionByName(previous.select("source", "newest_ts", "oldest_ts"))
    return both.groupBy("source").agg(
        F.max("newest_ts").alias("newest_ts"), F.min("oldest_ts").alias("oldest_ts")
    )
