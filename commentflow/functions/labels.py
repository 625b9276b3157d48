"""Label-list expressions, readable context and weak labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentflow.constants import (
    BUG_LABELS,
    BUG_TITLE_KEYWORDS,
    SECURITY_KEYWORDS,
    SECURITY_LABELS,
)
from commentflow.functions.text import contains_any, normalize_keywords, strip


def label_list(joined: Column) -> Column:
    """``a; B`` to ``[a, b]``: split at ``;``, drop empty parts, trim, lower-case."""
    parts = F.filter(F.split(F.coalesce(joined, F.lit("")), ";"), lambda x: x != "")
    return F.transform(parts, lambda x: F.lower(strip(x)))


def join_labels(labels: Column) -> Column:
    return F.array_join(F.coalesce(labels, F.array().cast("array<string>")), ";")


def build_context(title: Column, joined_labels: Column) -> Column:
    """``title [l1][l2]``, trimmed."""
    head = strip(F.coalesce(title, F.lit("")))
    parts = F.filter(F.split(strip(F.coalesce(joined_labels, F.lit(""))), ";"), lambda x: x != "")
    marks = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")
    return strip(F.concat(head, F.lit(" "), marks))


def weak_label(
    text: Column,
    title: Column,
    joined_labels: Column,
    security_labels: Sequence[str] = SECURITY_LABELS,
    bug_labels: Sequence[str] = BUG_LABELS,
    security_keywords: Sequence[str] = SECURITY_KEYWORDS,
    bug_title_keywords: Sequence[str] = BUG_TITLE_KEYWORDS,
    match: str = "substring",
) -> Column:
    """security, bug or other, from the container's labels and from keywords."""
    labels = label_list(joined_labels)

    def hinted(hints: Sequence[str]) -> Column:
        names = normalize_keywords(hints)
        return F.arrays_overlap(labels, F.array(*map(F.lit, names))) if names else F.lit(False)

    def mentioned(col: Column, words: Sequence[str]) -> Column:
        return contains_any(col, words, match) if normalize_keywords(words) else F.lit(False)

    security = (
        hinted(security_labels)
        | mentioned(title, security_keywords)
        | mentioned(text, security_keywords)
    )
    bug = hinted(bug_labels) | mentioned(title, bug_title_keywords)
    return F.when(security, "security").when(bug, "bug").otherwise("other")
