"""Token expressions: splitting, overlapping windows, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentflow.constants import MAX_LEN, OVERLAP, SPECIAL_TOKENS


def tokenize(text: Column) -> Column:
    """Default tokenizer: words between ASCII whitespace."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+")
    return F.filter(parts, lambda x: x != "")


def token_length(tokens: Column, special: int = SPECIAL_TOKENS) -> Column:
    """Length of the encoded text, special tokens included."""
    return F.size(tokens) + F.lit(special)


def _content(max_len: int, special: int) -> int:
    if max_len <= special:
        raise ValueError("max_len must exceed the special tokens")
    return max_len - special


def _step(max_len: int, overlap: int, special: int) -> int:
    step = _content(max_len, special) - overlap
    if overlap < 0 or step <= 0:
        raise ValueError("overlap must lie between 0 and the window content")
    return step


def window_count(
    n_tokens: Column,
    max_len: int = MAX_LEN,
    overlap: int = OVERLAP,
    max_windows: int | None = None,
    special: int = SPECIAL_TOKENS,
) -> Column:
    """Number of windows, from the token count alone."""
    content, step = _content(max_len, special), _step(max_len, overlap, special)
    extra = F.ceil((n_tokens - content) / F.lit(float(step))).cast("int")
    count = F.greatest(extra, F.lit(0)) + 1
    return count if max_windows is None else F.least(count, F.lit(int(max_windows)))


def token_windows(
    tokens: Column,
    max_len: int = MAX_LEN,
    overlap: int = OVERLAP,
    max_windows: int | None = None,
    special: int = SPECIAL_TOKENS,
) -> Column:
    """Array of overlapping windows; a text that fits gives one window.

    The windows are cut before any explode, so no output row carries the
    whole token list.
    """
    content, step = _content(max_len, special), _step(max_len, overlap, special)
    count = window_count(F.size(tokens), max_len, overlap, max_windows, special)
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.slice(tokens, i * step + 1, F.lit(content)),
    )


def truncate(tokens: Column, max_len: int = MAX_LEN, special: int = SPECIAL_TOKENS) -> Column:
    """Without sliding windows: the first window only."""
    return F.slice(tokens, 1, _content(max_len, special))
