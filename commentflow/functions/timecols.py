"""Timestamp expressions and per-source window bounds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentflow.constants import DEFAULT_DAYS, MAX_EPOCH_SECONDS

Instant = Column | datetime | str

STATELESS_MODES = ("days", "range", "window")
STATEFUL_MODES = ("newer", "older")


def instant(value: Instant, dtype: T.DataType | None = None) -> Column:
    """A timestamp literal of the column's own type.

    A literal of the other timestamp type would put a cast round the column
    and keep the filter from reaching the Parquet scan.
    """
    name = (dtype or T.TimestampType()).simpleString()
    if isinstance(value, Column):
        return value.cast(name)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc)
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value.replace("Z", "")).cast(name)


def parse_ts(col: Column) -> Column:
    """Text to timestamp, null when it cannot be read."""
    return F.try_to_timestamp(col.cast("string"))


def ts_coalesce(*cols: Column) -> Column:
    """First column that parses."""
    return F.coalesce(*[parse_ts(c) for c in cols])


def epoch_or_iso(col: Column) -> Column:
    """All-digit text is epoch seconds, anything else a date; null when neither."""
    text = col.cast("string")
    seconds = text.try_cast("bigint")
    return F.when(
        text.rlike(r"^[0-9]+\z"),
        F.when(seconds <= MAX_EPOCH_SECONDS, F.timestamp_seconds(seconds)),
    ).otherwise(F.try_to_timestamp(text))


def iso(col: Column) -> Column:
    """``2024-01-31T23:59:59Z``."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(col: Column) -> Column:
    return F.unix_seconds(col.cast("timestamp"))


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(int(n)))


def _seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def window_bounds(
    mode: str,
    now: Column,
    newest: Column | None = None,
    oldest: Column | None = None,
    days: int | None = None,
    since: Column | None = None,
    until: Column | None = None,
    from_days: int | None = None,
    to_days: int | None = None,
) -> tuple[Column, Column]:
    """Inclusive (low, high) of a selection mode.

    ``newest``/``oldest`` are the source's state and may hold nulls. In
    ``newer`` and ``window`` zero days means the default span, in ``days`` and
    ``older`` it means no span.
    """
    span = DEFAULT_DAYS if days is None else days
    nonzero_span = days or DEFAULT_DAYS
    if mode == "days":
        return now - _days(span), now
    if mode == "newer":
        start = now - _days(nonzero_span)
        low = start if newest is None else F.coalesce(newest + _seconds(1), start)
        return low, now if until is None else until
    if mode == "older":
        high = now if oldest is None else F.coalesce(oldest - _seconds(1), now)
        low = high - _days(span)
        return F.when(low > high, high - _seconds(1)).otherwise(low), high
    if mode == "range":
        if from_days is None or to_days is None:
            raise ValueError("mode range needs from_days and to_days")
        if from_days < to_days:
            raise ValueError("from_days must not be below to_days")
        return now - _days(from_days), now - _days(to_days)
    if mode == "window":
        high = now if until is None else until
        low = high - _days(nonzero_span) if since is None else since
        return F.when(low > high, high - _seconds(1)).otherwise(low), high
    raise ValueError(f"unknown mode: {mode}")
