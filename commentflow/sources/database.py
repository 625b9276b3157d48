"""Reading and replacing database tables through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC scan of a table or a SELECT.

    With a partition column and its range the scan runs over that many
    connections; without, the whole result comes through one task.
    """
    if not (table or query):
        raise ValueError("a table or a query is needed")
    options = {"url": url, "dbtable": f"({query}) q" if query else table, **extra}
    if partition_column:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs lower, upper and partitions")
        options.update(
            partitionColumn=partition_column, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions),
        )
    return options


def read_database(spark: SparkSession, url: str, limit: int | None = None, **options) -> DataFrame:
    df = spark.read.format("jdbc").options(**scan_options(url, **options)).load()
    return df if limit is None else df.limit(limit)


def replace_table(df: DataFrame, url: str, table: str, **extra: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **extra).mode("overwrite").save()
