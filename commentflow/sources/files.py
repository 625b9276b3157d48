"""Reading landed files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentflow.constants import GITHUB_COLUMNS
from commentflow.functions.text import strip
from commentflow.schema import GITHUB_CSV
from commentflow.sources.csv_records import read_csv


def read_comment_csv(spark: SparkSession, path: str, strict: bool = False, split: bool = True) -> DataFrame:
    """Comment CSV whose header may be missing, decided file by file; all columns as text.

    The known header is used as it is; a first cell with a ``/`` (owner/repo)
    means data, so the known names are put on; any other header is kept, or
    taken as data too when ``strict``. Quoted line breaks are part of the text;
    large files are still cut among many tasks (``csv_records``). ``split=False``
    uses the multi-line reader, one task per file, which also takes ``\\r`` alone
    as a line end.
    """
    def read(files: list[str], schema: T.StructType, header: bool) -> DataFrame:
        if split:
            return read_csv(spark, files, schema, header)
        return spark.read.options(multiLine=True, escape='"', header=header).schema(schema).csv(files)

    known, bare, other = [], [], {}
    for file, line in _first_lines(spark, path):
        # Header cells hold no line breaks, so one line is enough to decide.
        names = [cell.strip().strip('"') for cell in line.lstrip("\ufeff").split(",")]
        if names == GITHUB_COLUMNS:
            known.append(file)
        elif strict or "/" in names[0]:
            bare.append(file)
        else:
            other.setdefault(line, []).append(file)
    parts = [read(known, GITHUB_CSV, True)] if known else []
    parts += [read(bare, GITHUB_CSV, False)] if bare else []
    for files in other.values():
        # The names of another header as the reader makes them: only that line is read for it.
        plain = spark.read.options(multiLine=not split, escape='"', header=True).csv(files[:1]).schema
        parts.append(read(files, plain, True))
    if not parts:
        return spark.createDataFrame([], GITHUB_CSV)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _first_lines(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The first line of every file that has one: one row per file, like its listing."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        "value", F.monotonically_increasing_id().alias("place"),
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("line"))
    return [(r.file, r.line) for r in first.orderBy("file").collect()]


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; give the schema to avoid a pass that infers it."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By file ending: .csv, .parquet, else JSON lines."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_comment_csv(spark, path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_json_lines(spark, path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items to score: a table with a ``text`` column, or lines that are each a JSON
    record with text, id and context_id, a JSON string, or the bare text itself."""
    if path.lower().rstrip("/").endswith((".csv", ".parquet")):
        return read_any(spark, path)
    line = F.col("value")
    record = F.from_json(F.when(line.rlike(r"^\s*\{"), line), "id string, context_id string, text string")
    quoted = F.from_json(F.when(line.rlike(r"^\s*\""), F.concat(F.lit("["), line, F.lit("]"))), "array<string>")[0]
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(record.alias("r"), quoted.alias("q"), "value").select(
        "r.id", "r.context_id",
        F.when(F.col("r").isNotNull(), F.col("r.text")).otherwise(F.coalesce("q", "value")).alias("text"),
    )


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """One source per line; blank lines and lines that start with # are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("source"))
    return lines.filter((F.col("source") != "") & ~F.col("source").startswith("#"))


def restrict_sources(df: DataFrame, sources: DataFrame | Sequence[str], column: str = "repo") -> DataFrame:
    """Rows of the listed sources."""
    if isinstance(sources, DataFrame):
        names = sources.select(F.col("source").alias(column)).distinct()
        return df.join(names, column, "left_semi")
    return df.filter(F.col(column).isin(*sources))
