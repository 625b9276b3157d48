"""Token windows per document, length filter, class weights, label ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentflow.constants import MAX_LEN, OVERLAP, SPECIAL_TOKENS
from commentflow.functions import tokens as tk
from commentflow.functions.text import domain_prefix

TokenizeFn = Callable[[Column], Column]


def with_domain_prefix(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    return df.withColumn(text, F.concat(domain_prefix(F.col(source)), F.coalesce(text, F.lit(""))))


def drop_long(
    df: DataFrame, max_tokens: int, text: str = "text",
    tokenize: TokenizeFn = tk.tokenize, special: int = SPECIAL_TOKENS,
) -> DataFrame:
    """Drop whole documents of more than ``max_tokens`` tokens."""
    return df.filter(tk.token_length(tokenize(F.col(text)), special) <= max_tokens)


def explode_windows(
    df: DataFrame,
    text: str = "text",
    tokenize: TokenizeFn = tk.tokenize,
    max_len: int = MAX_LEN,
    overlap: int = OVERLAP,
    max_windows: int | None = None,
    special: int = SPECIAL_TOKENS,
    sliding: bool = True,
    max_input_tokens: int | None = None,
) -> DataFrame:
    """One row per window with window_no, tokens, attention_mask; the other
    columns are repeated and the text is dropped.

    Needs no shuffle: windows come from their own row.
    """
    df = df.withColumn("_tokens", tokenize(F.col(text)))
    if sliding:
        windows = tk.token_windows(F.col("_tokens"), max_len, overlap, max_windows, special)
    else:
        windows = F.array(tk.truncate(F.col("_tokens"), max_len, special))
    if max_input_tokens is not None:
        # Long documents get no array and so no rows. A filter would be pushed
        # below the column above and split every text a second time.
        windows = F.when(tk.token_length(F.col("_tokens"), special) <= max_input_tokens, windows)
    kept = [c for c in df.columns if c not in (text, "_tokens")]
    out = df.select(*kept, F.posexplode(windows).alias("window_no", "tokens"))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("tokens")))


def with_window_count(
    df: DataFrame, text: str = "text", tokenize: TokenizeFn = tk.tokenize,
    name: str = "n_windows", **options,
) -> DataFrame:
    """Windows per document without building them."""
    return df.withColumn(name, tk.window_count(F.size(tokenize(F.col(text))), **options))


def label_dictionary(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id): ids from 0 in sorted label order.

    The window runs over the distinct labels of a classifier, not over rows.
    """
    names = df.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    order = W.orderBy("label")
    return names.select("label", (F.row_number().over(order) - 1).cast("bigint").alias("label_id"))


def with_label_id(df: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """Label text to id. The dictionary has one row per class."""
    return df.join(dictionary.withColumnRenamed("label", label), label)


def with_label_text(df: DataFrame, dictionary: DataFrame, label_id: str = "label_id") -> DataFrame:
    return df.join(dictionary.withColumnRenamed("label_id", label_id), label_id)


def class_weights(
    df: DataFrame, label: str = "label", count: Column | None = None
) -> DataFrame:
    """Balanced weights n / (k * n_c) per label with its id.

    ``count`` is what a row counts for, e.g. its number of windows (null for
    none), so the windows themselves need not be built.
    """
    weight_of_row = F.lit(1) if count is None else count
    counts = (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(F.sum(weight_of_row.cast("bigint")).alias("n_rows"))
        .filter("n_rows > 0")
    )
    every, order = W.partitionBy(), W.orderBy("label")
    return counts.select(
        "label",
        (F.row_number().over(order) - 1).cast("bigint").alias("label_id"),
        "n_rows",
        (F.sum("n_rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_rows"))).alias("weight"),
    )


def weight_column(weights: DataFrame, df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``; a class without a weight counts 1."""
    table = weights.select(F.col("label").alias(label), "weight")
    return df.join(table, label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def window_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


WINDOW_COLUMNS: Sequence[str] = (
    "id", "context_id", "label", "source", "created_at", "window_no", "tokens", "attention_mask",
)
