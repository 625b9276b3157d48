"""Choosing comments: order in a thread, top-k per item, per-source budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentflow.operators.filters import is_body, removed, top_level
from commentflow.operators.ordered import group_rank

# Spark's window group limit keeps k rows per group in every map task, so what
# a hot group sends to its one reducer is k rows per task. That is fine for a
# few rows; for more, the group is first cut down in salted pieces.
DIRECT_LIMIT = 8
SALTS = 32
# Spark stops using the group limit beyond this k (the default of
# spark.sql.optimizer.windowGroupLimitThreshold); group_rank takes over.
SALTED_LIMIT = 1000


def _first_k(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | None,
    tie: str = "id",
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows per group. ``k`` None keeps all, ``k`` <= 0 none.

    ``tie`` is the unique column ``order`` ends in. ``rank`` names a one-based
    rank column.
    """
    if k is not None and k <= 0:
        out = df.filter(F.lit(False))
        return out.withColumn(rank, F.lit(None).cast("bigint")) if rank else out
    if k is None and rank is None:
        return df
    name = rank or "_rank"
    if k is None or k > SALTED_LIMIT:
        out = group_rank(df, keys, order, name).withColumn(name, F.col(name) + 1)
        if k is not None:
            out = out.filter(F.col(name) <= k)
    else:
        if k > DIRECT_LIMIT:
            salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)))
            df = _first_k(salted, [*keys, "_salt"], order, k, "_rank").drop("_salt", "_rank")
        out = _first_k(df, keys, order, k, name)
        if rank:
            out = out.withColumn(name, F.col(name).cast("bigint"))
    return out if rank else out.drop(name)


def policy_order(
    policy: str, created: str = "created_at", reactions: str = "reactions", tie: str = "id"
) -> list[Column]:
    """Sort columns of a selection policy; an unknown policy is oldest-first."""
    if policy == "newest":
        return [F.col(created).desc(), F.col(tie).asc()]
    if policy == "most-reacted":
        return [F.col(reactions).desc(), F.col(created).desc(), F.col(tie).asc()]
    return [F.col(created).asc(), F.col(tie).asc()]


def select_per_item(
    df: DataFrame,
    k: int | None,
    policy: str = "oldest",
    item: Sequence[str] = ("context_id",),
    rank: str | None = None,
    **columns: str,
) -> DataFrame:
    """k comments per issue, pull request or post by policy."""
    order = policy_order(policy, **columns)
    return top_k(df, list(item), order, k, columns.get("tie", "id"), rank)


def select_by_score(
    df: DataFrame,
    k: int | None,
    item: Sequence[str] = ("context_id",),
    parent: str = "parent_id",
    body: str = "text",
    score: str = "score",
    tie: str = "id",
) -> DataFrame:
    """Best scored live top-level comments per post.

    Apply the time window and drop landed ids first: only new rows count.
    """
    live = df.filter(top_level(F.col(parent)) & ~removed(F.coalesce(body, F.lit(""))))
    return top_k(live, list(item), [F.col(score).desc(), F.col(tie).asc()], k, tie)


def thread_order_columns(
    comment_type: str = "comment_type", created: str = "created_at", tie: str = "id"
) -> list[Column]:
    """Bodies first, then by time."""
    return [
        F.when(is_body(F.col(comment_type)), 0).otherwise(1).asc(),
        F.col(created).asc(),
        F.col(tie).asc(),
    ]


def thread_order(
    df: DataFrame, keys: Sequence[str] = ("repo", "issue_number"), rank: str = "position", **columns: str
) -> DataFrame:
    """One-based position of each row in its thread."""
    ranked = group_rank(df, list(keys), thread_order_columns(**columns), rank)
    return ranked.withColumn(rank, F.col(rank) + 1)


def sort_threads(
    df: DataFrame, keys: Sequence[str] = ("repo", "issue_number"), **columns: str
) -> DataFrame:
    """All rows in thread order, for writing sorted files."""
    return df.orderBy(*[F.col(k).asc() for k in keys], *thread_order_columns(**columns))


def budget_order(
    inside: Sequence[Column], is_pr: str = "is_pr", updated: str = "container_updated_at", item: str = "issue_number"
) -> list[Column]:
    """In which order a source's comments use up its budget."""
    return [F.col(is_pr).asc(), F.col(updated).desc(), F.col(item).asc(), *inside]


def source_budget(
    df: DataFrame,
    budget: int | None,
    source: str = "repo",
    is_pr: str = "is_pr",
    item: str = "issue_number",
    updated: str = "container_updated_at",
    comment_type: str = "comment_type",
    order_in_item: Sequence[Column] | None = None,
    tie: str = "id",
) -> DataFrame:
    """At most ``budget`` comments per source: issues before pull requests,
    fresh containers first, policy order inside an item. Bodies are free.

    Pass rows that are new; the budget is per call. ``streaming.ledger`` keeps one
    over many batches.
    """
    if budget is None:
        return df
    if budget <= 0:
        return df.filter(is_body(F.col(comment_type)))
    inside = list(order_in_item) if order_in_item is not None else policy_order("oldest", tie=tie)
    order = budget_order(inside, is_pr, updated, item)
    # Each body is a group of its own, so one pass ranks the comments and
    # lets every body through.
    grouped = df.withColumn("_body", F.when(is_body(F.col(comment_type)), F.col(tie)))
    return top_k(grouped, [source, "_body"], order, budget, tie).drop("_body")
