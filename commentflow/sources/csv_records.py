"""Records of large CSV files, cut by many tasks.

A quoted field may hold line breaks, so whether a line begins a record depends on all
lines before it. But a line needs to know only one thing of them: whether they leave a
quote open. Each task therefore reads its byte range under both assumptions and notes,
per line, the state and record number that either leads to. A range is then a function
from the state before it to the state after it; the functions of a file's ranges (one
small row each) are composed in order, which gives every range its true start. Lines
that are a record by themselves, nearly all, stay where they were read; only the lines
of records with line breaks are brought together, also over range borders.

A quote opens a field at its beginning only; two quotes inside a field are one.
Line ends are ``\\n`` or ``\\r\\n``. The rows equal those of the multi-line reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = "file string, start long, n long, value string, b0 boolean, b1 boolean, e0 boolean, e1 boolean, r0 long, r1 long"
_FOLD = """aggregate(sort_array(blocks),
    named_struct('open', false, 'base', 0L, 'out', cast(array() AS array<struct<start: bigint, open: boolean, base: bigint>>)),
    (a, b) -> named_struct('open', if(a.open, b.e1, b.e0), 'base', a.base + if(a.open, b.r1, b.r0),
        'out', array_append(a.out, named_struct('start', b.start, 'open', a.open, 'base', a.base))),
    a -> a.out)"""


def _opens(text: Column) -> Column:
    """Whether a text without doubled quotes leaves a quoted field open."""
    return F.regexp_replace(text, r'(^|,)"[^"]*+"', "$1").rlike(r'(?:^|,)"')


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line with its states under both assumptions (0: outside a quote, 1: inside)."""
    bare = F.replace("value", F.lit('""'), F.lit(""))
    read = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.contains("value", F.lit('"')).alias("quoted"), _opens(bare).alias("o"),
        F.when(bare.rlike(r'^[^"]*+"'), _opens(F.regexp_replace(bare, r'^[^"]*+"', "x"))).otherwise(True).alias("i"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            file, start, quoted, o, i = (batch.column(c).to_pylist() for c in ("file", "start", "quoted", "o", "i"))
            rows = []
            for k in range(batch.num_rows):
                if (file[k], start[k]) != here:
                    here, n, s0, s1, r0, r1 = (file[k], start[k]), 0, False, True, 0, 0
                b0, b1 = s0, s1
                if quoted[k]:
                    s0, s1 = (i[k] if s else o[k] for s in (s0, s1))
                rows.append((n, b0, b1, s0, s1, r0, r1))
                n, r0, r1 = n + 1, r0 + (not s0), r1 + (not s1)
            new = [pa.array(c) for c in zip(*rows, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("file"), batch.column("start"), new[0], batch.column("value"), *new[1:]],
                    ["file", "start", "n", "value", "b0", "b1", "e0", "e1", "r0", "r1"],
                )

    return read.mapInArrow(run, _LINE)


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows (file, record, text): the records of each file, numbered from 0."""
    lines = _lines(spark, paths)
    last = F.max_by(
        F.struct("e0", "e1", (F.col("r0") + (~F.col("e0")).cast("long")).alias("r0"), (F.col("r1") + (~F.col("e1")).cast("long")).alias("r1")), "n"
    )
    blocks = lines.groupBy("file", "start").agg(last.alias("l")).groupBy("file").agg(
        F.collect_list(F.struct("start", "l.e0", "l.e1", "l.r0", "l.r1")).alias("blocks")
    )
    starts = blocks.select(F.col("file").alias("_file"), F.inline(F.expr(_FOLD))).withColumnRenamed("start", "_start")
    # Both scans must cut the files alike; a line of an unknown range stops the job.
    opened = F.coalesce(F.col("open"), F.raise_error(F.lit("byte ranges changed while the file was read")).cast("boolean"))
    placed = lines.join(starts, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left").select(
        "file", "start", "n", "value", F.when(opened, F.col("b1")).otherwise(F.col("b0")).alias("before"),
        F.when(opened, F.col("e1")).otherwise(F.col("e0")).alias("after"),
        (F.col("base") + F.when(opened, F.col("r1")).otherwise(F.col("r0"))).alias("record"),
    )
    whole = placed.filter("NOT before AND NOT after").select("file", "record", F.col("value").alias("text"))
    parts = placed.filter("before OR after").groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "value"))).alias("lines")
    )
    joined = parts.select("file", "record", F.array_join("lines.value", "\n").alias("text"))
    text = F.regexp_replace(F.col("text"), "\r$", "")
    first = F.when(F.col("record") == 0, F.ltrim(text, F.lit("﻿"))).otherwise(text)
    return whole.unionByName(joined).withColumn("text", first).filter("text <> ''")


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, header: bool) -> DataFrame:
    """The files' rows by a schema; ``header``: the first record of each file names columns."""
    found = records(spark, paths)
    if header:
        found = found.filter("record > 0")
    options = {"escape": '"', "mode": "PERMISSIVE"}
    kind = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return found.select(F.from_csv("text", kind, options).alias("_r")).select("_r.*")
