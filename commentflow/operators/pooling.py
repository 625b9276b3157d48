"""Chunk scores to comment scores, and scoring of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.constants import MAX_LEN, OVERLAP, SNIPPET_CHARS, SPECIAL_TOKENS
from commentflow.functions import scores as sc
from commentflow.functions import tokens as tk
from commentflow.functions.text import text_sample
from commentflow.operators.windows import TokenizeFn, window_text


def chunk_probability(df: DataFrame, class_index: int, logits: str = "logits", name: str = "p") -> DataFrame:
    """Softmax probability of one class per chunk."""
    return df.withColumn("probs", sc.softmax(F.col(logits))).withColumn(
        name, F.col("probs")[class_index]
    )


def max_pool(
    chunks: DataFrame, keys: Sequence[str] = ("id", "context_id"), p: str = "p", y: str | None = "y"
) -> DataFrame:
    """Highest probability and highest binary label per comment."""
    aggs = [F.max(p).alias("score")]
    if y is not None:
        aggs.append(F.max(y).alias("y"))
    return chunks.groupBy(*keys).agg(*aggs)


def best_window(
    chunks: DataFrame,
    keys: Sequence[str] = ("id", "context_id"),
    p: str = "p",
    window_no: str = "window_no",
    carry: Sequence[str] = ("probs",),
) -> DataFrame:
    """The first window with the highest probability, with the named columns."""
    place = F.struct(F.col(p), -F.col(window_no))
    best = F.max_by(F.struct(window_no, *carry), place).alias("_best")
    pooled = chunks.groupBy(*keys).agg(F.max(p).alias("score"), best)
    return pooled.select(*keys, "score", F.col("_best.*"))


def _response(
    keep: Sequence[str], has_text: Column, score: Column, snippet: Column, probs: Column,
    labels: Sequence[str], threshold: float, version: dict[str, str] | None, snippet_chars: int,
) -> list[Column | str]:
    """The columns of a scoring answer; a comment without text scores 0, band low."""
    score = F.when(has_text, score).otherwise(0.0)
    no_probs = F.create_map().cast("map<string,double>")
    pairs = [F.lit(str(x)) for kv in (version or {}).items() for x in kv]
    return [
        *keep,
        score.alias("score_security"),
        (has_text & (score >= threshold)).alias("is_security"),
        F.when(has_text, sc.triage_band(score, threshold)).otherwise("low").alias("band"),
        F.when(has_text, text_sample(snippet, snippet_chars)).otherwise("").alias("best_snippet"),
        F.when(has_text, sc.class_probs(probs, labels)).otherwise(no_probs).alias("class_probs"),
        F.create_map(*pairs).cast("map<string,string>").alias("version"),
    ]


def score_windows(
    chunks: DataFrame,
    labels: Sequence[str],
    threshold: float,
    positive: str = "security",
    row: str = "row",
    version: dict[str, str] | None = None,
    snippet_chars: int = SNIPPET_CHARS,
    keep: Sequence[str] = ("id", "context_id"),
) -> DataFrame:
    """Scoring answers from exploded windows with logits, for models that work
    on rows. ``row`` tells comments apart, whose ids may be missing."""
    rated = chunk_probability(chunks, list(labels).index(positive)).withColumn(
        "_text", window_text(F.col("tokens"))
    )
    best = best_window(rated, [row, *keep], carry=("probs", "_text"))
    return best.select(*_response(
        keep, F.col("_text") != "", F.col("score"), F.col("_text"), F.col("probs"),
        labels, threshold, version, snippet_chars,
    ))


# Texts of one row's windows to one array of logits per window.
LogitsFn = Callable[[Column], Column]


class Scorer(Protocol):
    """A model a user plugs in. ``load`` runs once per Python worker and gives
    a function from window texts to an array of shape [windows, labels]."""

    def load(self) -> Callable[[list[str]], np.ndarray]: ...


class Tokenizer(Protocol):
    """A sub-word tokenizer a user plugs in; ``load`` runs once per worker."""

    def load(self) -> Callable[[str], list[str]]: ...


# Bytes of text that a plug-in gets, and answers, before the next are taken.
SLICE_BYTES = 1 << 20


def _numbers(counts: pa.Array) -> np.ndarray:
    return pc.fill_null(counts, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _slices(rows: pa.Array, size: np.ndarray) -> Iterator[pa.Array]:
    """Slices of about ``SLICE_BYTES`` by the rows' sizes (one row at least), none left out."""
    group = np.cumsum(size) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        yield rows.slice(a, b - a)


def pandas_logits(scorer: Scorer, batch_size: int = 32) -> LogitsFn:
    """Run a plugged-in model over Arrow batches of rows, cut into slices of bounded text.

    The windows of all rows in a slice go to the model ``batch_size`` at a time. Only
    those are Python strings, and the logits stay numbers.
    """
    @F.arrow_udf("array<array<double>>")
    def logits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = scorer.load()

        def rate(windows: pa.Array) -> pa.Array:
            flat, values, widths = windows.flatten(), [np.empty(0)], [np.empty(0, np.int64)]
            for at in range(0, len(flat), batch_size):
                texts = flat.slice(at, batch_size).to_pylist()
                found = np.asarray(predict(texts), dtype=float)
                if found.ndim != 2 or len(found) != len(texts):
                    raise ValueError(f"the model gave logits of shape {found.shape} for {len(texts)} windows")
                values.append(found.ravel())
                widths.append(np.full(len(texts), found.shape[1]))
            inner = pa.array(_ends(np.concatenate(widths)), pa.int32())
            outer = pa.array(_ends(_numbers(pc.list_value_length(windows))), pa.int32())
            return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, pa.array(np.concatenate(values))))

        for batch in batches:
            upto = _ends(_numbers(pc.binary_length(batch.flatten())))
            size = np.diff(upto[_ends(_numbers(pc.list_value_length(batch)))])
            yield from map(rate, _slices(batch, size))

    return logits


def pandas_tokenize(tokenizer: Tokenizer) -> TokenizeFn:
    """Run a plugged-in tokenizer over Arrow batches, cut into slices of bounded text."""
    @F.arrow_udf("array<string>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = tokenizer.load()
        for batch in batches:
            for texts in _slices(batch, _numbers(pc.binary_length(batch))):
                found = [list(split(text or "")) for text in texts.to_pylist()]
                yield pa.array(found, pa.list_(pa.string()))

    return tokens


def score_comments(
    df: DataFrame,
    logits: LogitsFn,
    labels: Sequence[str],
    threshold: float,
    positive: str = "security",
    version: dict[str, str] | None = None,
    tokenize: TokenizeFn = tk.tokenize,
    max_len: int = MAX_LEN,
    overlap: int = OVERLAP,
    special: int = SPECIAL_TOKENS,
    snippet_chars: int = SNIPPET_CHARS,
    keep: Sequence[str] = ("id", "context_id"),
) -> DataFrame:
    """Score, band, best snippet and class probabilities per comment.

    Windows, logits and probabilities stay in arrays of the comment's own row,
    so pooling needs no shuffle. A comment without text scores 0, band low.
    """
    index = list(labels).index(positive)
    texts = F.transform(
        tk.token_windows(F.col("_tokens"), max_len, overlap, None, special), window_text
    )
    filled = F.size("_tokens") > 0
    staged = (
        df.select(*keep, tokenize(F.col("text")).alias("_tokens"))
        .withColumn("_windows", F.when(filled, texts).otherwise(F.array().cast("array<string>")))
        .withColumn("_logits", logits(F.col("_windows")))
        .withColumn("_probs", F.transform("_logits", sc.softmax))
        .withColumn("_p", F.transform("_probs", lambda x: x[index]))
        .withColumn("_best", sc.argmax(F.col("_p")).cast("int"))
    )
    return staged.withColumn("_score", F.array_max("_p")).select(*_response(
        keep, F.size("_windows") > 0, F.col("_score"), F.get("_windows", F.col("_best")),
        F.get("_probs", F.col("_best")), labels, threshold, version, snippet_chars,
    ))
