"""Word columns shared by the operators: words are runs without ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; a null or blank text has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]"), "")
    )


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    marks = F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[^w]+", ""))
    return F.coalesce(marks, F.lit(0)).cast("bigint")
