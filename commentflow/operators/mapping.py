"""From any landed layout to the core columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentflow.constants import (
    CREATED_CANDIDATES,
    EXTENDED_COLUMNS,
    ID_CANDIDATES,
    MAX_EPOCH_SECONDS,
    TEXT_CANDIDATES,
    URL_CANDIDATES,
)
from commentflow.functions.text import is_blank, light_norm
from commentflow.functions.timecols import Instant, epoch_or_iso, instant


def _first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def infer_source(df: DataFrame, github: str = "github.com", reddit: str = "reddit") -> Column:
    """github, reddit or unknown, from the first non-empty URL column, then subreddit."""
    urls = [F.nullif(F.col(c), F.lit("")) for c in URL_CANDIDATES if c in df.columns]
    url = F.lower(F.coalesce(*urls, F.lit("")))
    out = F.when(url.contains(github), "github").when(url.contains(reddit), "reddit")
    if "subreddit" in df.columns:
        out = out.when(~is_blank(F.col("subreddit")), "reddit")
    return out.otherwise("unknown")


def _context_id(df: DataFrame, id_col: Column) -> Column:
    present = set(df.columns)
    if {"repo", "issue_number"} <= present:
        return F.concat(F.col("repo"), F.lit("#n:"), F.col("issue_number").cast("string"))
    if "link_id" in present:
        return F.col("link_id").cast("string")
    if "permalink" in present:
        return F.col("permalink").cast("string")
    if "submission_id" in present:
        return F.concat(F.lit("reddit#post:"), F.col("submission_id"))
    return id_col


def to_core(
    df: DataFrame,
    now: Instant,
    default_label: str | None = "other",
    default_source: str | None = None,
    github: str = "github.com",
    reddit: str = "reddit",
) -> DataFrame:
    """Add the six core columns that are missing; other columns stay.

    ``created_at`` stays as landed (see ``normalize``). An input with no id
    column gets a hash of its content, which does not depend on row order.
    """
    text_name = _first_present(df, TEXT_CANDIDATES)
    if text_name is None:
        raise ValueError(f"no text column among {TEXT_CANDIDATES}")
    added: dict[str, Column] = {}
    if text_name != "text":
        added["text"] = F.col(text_name)
    source = F.col("source")
    if "source" not in df.columns:
        source = F.lit(default_source) if default_source else infer_source(df, github, reddit)
        added["source"] = source
    id_name = _first_present(df, ID_CANDIDATES)
    if id_name is None:
        parts = [F.coalesce(source, F.lit("")), *(F.col(c).cast("string") for c in ("context_id",) if c in df.columns),
                 F.coalesce(F.col(text_name), F.lit(""))]
        id_col = F.sha2(F.concat_ws("|", *parts), 256)
    else:
        id_col = F.col(id_name).cast("string")
    added["id"] = id_col
    if "created_at" not in df.columns:
        created_name = _first_present(df, CREATED_CANDIDATES)
        added["created_at"] = F.col(created_name) if created_name else instant(now)
    if "context_id" not in df.columns:
        added["context_id"] = _context_id(df, id_col)
    if "label" not in df.columns:
        added["label"] = F.lit(default_label).cast("string")
    return df.withColumns(added)


def normalize_time(df: DataFrame, now: Instant) -> DataFrame:
    """``created_at`` as a timestamp; an unreadable time becomes ``now`` and is
    marked in ``created_at_imputed``."""
    dtype = df.schema["created_at"].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        parsed = F.col("created_at").cast("timestamp")
    elif isinstance(dtype, T.NumericType):
        seconds = F.col("created_at").cast("double")
        parsed = F.when(F.abs(seconds) <= MAX_EPOCH_SECONDS, F.timestamp_seconds(seconds))
    else:
        parsed = epoch_or_iso(F.col("created_at"))
    return df.withColumns({
        "created_at": F.coalesce(parsed, instant(now)),
        "created_at_imputed": parsed.isNull(),
    })


def normalize(df: DataFrame, now: Instant) -> DataFrame:
    """Normalised text and time."""
    return normalize_time(df, now).withColumn("text", light_norm(F.col("text")))


def parse_bool(col: Column) -> Column:
    """true/false in any case to boolean, anything else null."""
    low = F.lower(col.cast("string"))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def fill_text(df: DataFrame, columns: Sequence[str] = ("container_title", "container_labels", "text", "comment_author")) -> DataFrame:
    """Missing text columns and nulls become empty strings."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        for c in columns
    })


def extended_core(df: DataFrame, source: str | None = None) -> DataFrame:
    """The 14 columns kept for training data, with an optional literal source."""
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    return df.select(*EXTENDED_COLUMNS)


def union_inputs(frames: Sequence[DataFrame], order: str = "src_ord") -> DataFrame:
    """Inputs with differing columns, one after another; ``order`` keeps which."""
    if not frames:
        raise ValueError("no input")
    out = None
    for i, frame in enumerate(frames):
        frame = frame.withColumn(order, F.lit(i))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out
