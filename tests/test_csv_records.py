"""Records cut at any byte equal those of the multi-line reader."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from commentflow.sources.csv_records import read_csv, records
from commentflow.sources.files import read_comment_csv

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that records lie on their borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def both(spark, path, header=True):
    plain = spark.read.options(multiLine=True, escape='"', header=header).schema(SCHEMA).csv(path)
    return Counter(map(tuple, read_csv(spark, path, SCHEMA, header).collect())), Counter(map(tuple, plain.collect()))


def write(path, rows, eol="\n", end=True):
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(eol.join(rows) + (eol if end else ""))


@pytest.mark.parametrize("seed", range(4))
def test_random_files(small_ranges, tmp_path, seed):
    draw = random.Random(seed)

    def cell():
        text = "".join(draw.choices(["x", "y ", ",", "\n", '""', "é", " "], k=draw.randint(0, 12)))
        return f'"{text}"' if draw.random() < 0.5 else text.replace('""', "").replace(",", "").replace("\n", "")

    for f in range(2):
        rows = ["a,b,c"] + [",".join(cell() for _ in range(3)) for _ in range(60)]
        write(tmp_path / f"{f}.csv", rows, "\r\n" if seed % 2 else "\n", bool(seed % 3))
    got, want = both(small_ranges, str(tmp_path))
    assert got == want and sum(got.values()) == 120


def test_one_field_over_many_ranges(small_ranges, tmp_path):
    """A quoted field longer than several ranges, full of lines that look like records."""
    long = "\n".join(f'line {i},""q"",{i}' for i in range(200))
    write(tmp_path / "x.csv", ["a,b,c", "1,2,3", f'4,"{long}",5', "6,7,8", '9,"",""""', ",,", "", "10"])
    got, want = both(small_ranges, str(tmp_path))
    assert got == want
    assert ("4", long.replace('""', '"'), "5") in got
    lines = small_ranges.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    assert [r.record for r in records(small_ranges, str(tmp_path)).orderBy("record").collect()] == [0, 1, 2, 3, 4, 5, 7]


def test_many_tasks_share_a_file(spark, small_ranges, tmp_path):
    write(tmp_path / "x.csv", ["a,b,c"] + [f'{i},"one\ntwo",{i}' for i in range(500)])
    plan = read_csv(small_ranges, str(tmp_path), SCHEMA, True)
    assert plan.rdd.getNumPartitions() > 3 and plan.count() == 500


def test_empty_and_headers(spark, tmp_path):
    (tmp_path / "e").mkdir()
    write(tmp_path / "e" / "x.csv", [], end=False)
    assert read_csv(spark, str(tmp_path / "e"), SCHEMA, False).count() == 0
    (tmp_path / "h").mkdir()
    write(tmp_path / "h" / "x.csv", ["﻿id,text", '1,"a\nb"', "2,"])
    for split in (True, False):
        got = read_comment_csv(spark, str(tmp_path / "h"), split=split)
        assert got.columns == ["id", "text"] and sorted(map(tuple, got.collect())) == [("1", "a\nb"), ("2", None)]
