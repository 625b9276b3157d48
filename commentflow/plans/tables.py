"""Comment-shaped views of the given tables, one per kind of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
LANDED_UNTIL = "2024-01-11 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: Column) -> Column:
    """Timestamps leave the queries as microseconds, the same in every engine."""
    return F.unix_micros(col.cast("timestamp"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_comments(read(spark, sf_dir, "events"))


def as_comments(events: DataFrame) -> DataFrame:
    """Events as comments of eleven repositories; one item per user."""
    kind = (
        F.when(F.col("event_type") == "signup", "issue_body")
        .when(F.col("event_type") == "view", "pr_body")
        .otherwise("issue_comment")
    )
    repo = F.concat(F.lit("src"), (F.col("user_id") % 11).cast("string"))
    return events.select(
        F.col("event_id").alias("id"),
        repo.alias("repo"),
        (F.col("user_id") % 2 == 1).alias("is_pr"),
        F.col("user_id").alias("issue_number"),
        F.concat(repo, F.lit("#"), F.col("user_id").cast("string")).alias("context_id"),
        F.col("ts").alias("created_at"),
        kind.alias("comment_type"),
        F.col("event_type").alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("reactions"),
        F.col("value").alias("score"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments; the first line is the title, language and source
    are the labels."""
    doc = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        doc.alias("id"),
        "text",
        "lang",
        "source",
        F.concat("source", F.lit("#"), (doc % 50).cast("string")).alias("context_id"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 3600).alias("created_at"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat_ws(";", "lang", "source").alias("labels"),
    )


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments of earlier runs."""
    rows = comments(spark, sf_dir)
    return rows.filter(F.col("created_at") < F.lit(LANDED_UNTIL).cast("timestamp_ntz"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score of two digits, so that scores repeat."""
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "test").otherwise("validation").alias("split"),
        ((F.col("doc_id") * 7919 % 101) / F.lit(100.0)).alias("score"),
        F.col("quality").alias("y"),
    )


def _part_sum(values: Column, at: int, n: int) -> Column:
    """Sum of part of a vector in millionths, so that its order does not matter."""
    micro = F.transform(F.slice(values, at, n), lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
    return F.aggregate(micro, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double") / 1000000


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, summed in three parts to three logits per window, five windows per comment."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("id"),
        F.concat(F.lit("ctx"), F.floor(F.col("vec_id") / 50).cast("string")).alias("context_id"),
        (F.col("vec_id") % 5).alias("window_no"),
        F.array(*[_part_sum(e, at, n) for at, n in ((1, 21), (22, 21), (43, 22))]).alias("logits"),
        (F.col("label") % 3).cast("bigint").alias("y"),
    )
