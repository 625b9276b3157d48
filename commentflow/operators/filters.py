"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.constants import BOT_PATTERN, MIN_WORDS, REMOVED_BODIES, TEMPLATE_SENTENCES
from commentflow.functions.text import contains_any, has_words, is_blank, strip
from commentflow.functions.timecols import (
    STATELESS_MODES,
    Instant,
    instant,
    window_bounds,
)

# Comment types that hold a container's own text.
BODY_TYPES = ["issue_body", "pr_body", "post_body"]


def is_body(comment_type: Column) -> Column:
    return F.coalesce(comment_type.isin(*BODY_TYPES), F.lit(False))


def top_level(parent_id: Column) -> Column:
    """Replies to the post itself, not to another comment."""
    return parent_id.startswith("t3_")


def removed(body: Column) -> Column:
    """Comments taken down by their author or a moderator."""
    return strip(body).isin(*REMOVED_BODIES)


def is_noise(
    author: Column,
    text: Column,
    bot_pattern: str = BOT_PATTERN,
    templates: Sequence[str] = TEMPLATE_SENTENCES,
    min_words: int = MIN_WORDS,
) -> Column:
    """Bots, very short comments and template sentences."""
    bot = F.coalesce(F.lower(author).rlike(bot_pattern), F.lit(False))
    template = contains_any(text, templates) if templates else F.lit(False)
    return bot | ~has_words(text, min_words) | template


def drop_noise(df: DataFrame, author: str = "comment_author", text: str = "text", **options) -> DataFrame:
    return df.filter(~is_noise(F.col(author), F.col(text), **options))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(text)))


def keep_keywords(df: DataFrame, fields: dict[str, Iterable[str]], match: str = "substring") -> DataFrame:
    """Keep rows where every listed column holds one of its keywords.

    An empty list passes all rows.
    """
    for column, words in fields.items():
        df = df.filter(contains_any(F.col(column), words, match))
    return df


def body_policy(
    df: DataFrame,
    include: str = "comments",
    comment_type: str = "comment_type",
    text: str = "text",
    nonblank_bodies: bool = False,
) -> DataFrame:
    """``comments``, ``bodies`` or ``both``; optionally only bodies with text."""
    body = is_body(F.col(comment_type))
    if nonblank_bodies:
        df = df.filter(~body | ~is_blank(F.col(text)))
    if include == "comments":
        return df.filter(~body)
    if include == "bodies":
        return df.filter(body)
    if include == "both":
        return df
    raise ValueError(f"unknown body policy: {include}")


def since(df: DataFrame, column: str, low: Instant) -> DataFrame:
    """column >= low, as a filter the scan can use.

    Serves the cut-off in days and the pruning of stale containers alike.
    """
    return df.filter(F.col(column) >= instant(low, df.schema[column].dataType))


def in_window(
    df: DataFrame,
    mode: str,
    now: Instant,
    state: DataFrame | None = None,
    source: str = "repo",
    created: str = "created_at",
    since: Instant | None = None,
    until: Instant | None = None,
    **spans: int | None,
) -> DataFrame:
    """Rows whose time lies in the mode's inclusive window of their source.

    Modes that need no state become a literal filter on the scan; the others
    join the state table on the source (Spark broadcasts it while it is small
    and splits hot sources otherwise).
    """
    dtype = df.schema[created].dataType
    fixed = dict(
        now=instant(now, dtype),
        since=None if since is None else instant(since, dtype),
        until=None if until is None else instant(until, dtype),
        **spans,
    )
    if mode in STATELESS_MODES or state is None:
        low, high = window_bounds(mode, **fixed)
        return df.filter(F.col(created).between(low, high))
    bounds = source_bounds(state, mode, now, since=since, until=until, like=dtype, **spans)
    low, high = window_bounds(mode, **fixed)
    # The lowest bound of any source prunes the scan, before the exact test per source. Only a
    # bare subquery reaches Parquet (two would be merged into a struct), so the default is
    # compared inside it. The upper bound is the same for all sources, or at least ``high``.
    lowest = bounds.agg(F.least(low, F.min("low_ts")).alias("low"))
    df = df.filter(F.col(created) >= lowest.scalar())
    if mode == "newer":
        df = df.filter(F.col(created) <= high)
    joined = df.join(bounds.withColumnRenamed("source", "_source"), F.col(source) == F.col("_source"), "left")
    kept = joined.filter(
        F.col(created).between(F.coalesce("low_ts", low), F.coalesce("high_ts", high))
    )
    return kept.drop("_source", "low_ts", "high_ts")


def fresh(
    df: DataFrame,
    mode: str,
    now: Instant,
    state: DataFrame | None = None,
    source: str = "repo",
    updated: str = "updated_at",
    since: Instant | None = None,
    until: Instant | None = None,
    **spans: int | None,
) -> DataFrame:
    """Containers that changed at or after the lower bound of their source's window.

    An older one cannot hold a comment of the window, so its entries need no
    unnesting. Containers without a time of change stay.
    """
    dtype = df.schema[updated].dataType
    low, _ = window_bounds(
        mode, now=instant(now, dtype),
        since=None if since is None else instant(since, dtype),
        until=None if until is None else instant(until, dtype), **spans,
    )
    changed = F.col(updated)
    if mode in STATELESS_MODES or state is None:
        return df.filter(changed.isNull() | (changed >= low))
    bounds = source_bounds(state, mode, now, since=since, until=until, like=dtype, **spans)
    bounds = bounds.select(F.col("source").alias("_source"), "low_ts")
    joined = df.join(bounds, F.col(source) == F.col("_source"), "left")
    return joined.filter(changed.isNull() | (changed >= F.coalesce("low_ts", low))).drop("_source", "low_ts")


def source_bounds(
    state: DataFrame,
    mode: str,
    now: Instant,
    since: Instant | None = None,
    until: Instant | None = None,
    like=None,
    **spans: int | None,
) -> DataFrame:
    """(source, low_ts, high_ts) for a state table (source, newest_ts, oldest_ts)."""
    dtype = like or state.schema["newest_ts"].dataType
    kind = dtype.simpleString()
    low, high = window_bounds(
        mode,
        now=instant(now, dtype),
        newest=F.col("newest_ts").cast(kind),
        oldest=F.col("oldest_ts").cast(kind),
        since=None if since is None else instant(since, dtype),
        until=None if until is None else instant(until, dtype),
        **spans,
    )
    return state.select("source", low.alias("low_ts"), high.alias("high_ts"))


def backfill(
    df: DataFrame,
    state: DataFrame,
    start: Instant,
    source: str = "subreddit",
    created: str = "submission_created_utc",
) -> DataFrame:
    """Posts from ``start`` on that are older than the source's backfill mark.

    A source whose mark lies at or before ``start`` gives nothing.
    """
    kind = df.schema[created].dataType.simpleString()
    marks = state.select(F.col("source").alias("_source"), F.col("oldest_ts").cast(kind).alias("_mark"))
    recent = df.filter(F.col(created) >= instant(start, df.schema[created].dataType))
    joined = recent.join(marks, F.col(source) == F.col("_source"), "left")
    return joined.filter(F.col("_mark").isNull() | (F.col(created) < F.col("_mark"))).drop(
        "_source", "_mark"
    )
