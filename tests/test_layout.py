"""Clustered files are skipped by bounds on source and time; bounded reports; many keywords."""

import glob
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from commentflow.functions import text as tx
from commentflow.operators import report
from commentflow.sources import sinks


def comments(spark, n):
    """A third of the rows in one source, the others in forty, over a year, in no order."""
    i = F.col("id")
    return spark.range(n).select(
        i, F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.xxhash64(i) % 40).cast("string"))).alias("repo"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64(i + 7), F.lit(365 * 86400))).alias("created_at"), F.repeat(F.lit("x"), 20).alias("text"),
    )


def groups_hit(path, repo, low, high):
    """(row groups that could hold such rows, all row groups)."""
    hit = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            r, t = (meta.row_group(g).column(at[c]).statistics for c in ("repo", "created_at"))
            total += 1
            hit += r.min <= repo <= r.max and t.min.timestamp() < high and t.max.timestamp() >= low
    return hit, total


def test_fewer_row_groups(spark, tmp_path):
    df = comments(spark, 120_000)
    sinks.write_clustered(df, str(tmp_path / "clustered"), row_group=1 << 16)
    df.coalesce(8).write.option("parquet.block.size", 1 << 16).parquet(str(tmp_path / "plain"))
    low = 1704067200 + 100 * 86400
    for repo in ("hot", "s5"):
        hit, total = groups_hit(tmp_path / "clustered", repo, low, low + 7 * 86400)
        plain, n = groups_hit(tmp_path / "plain", repo, low, low + 7 * 86400)
        assert plain == n and hit * 5 < total, (repo, hit, total)
    back = spark.read.parquet(str(tmp_path / "clustered"))
    assert back.exceptAll(df).isEmpty() and back.count() == 120_000 and back.columns == df.columns


def test_layout_edges(spark):
    rows = [(1, None, None), (2, "a", None), (3, None, "2024-01-01"), (3, None, "2024-01-01"), (4, "b", "1960-01-01")]
    df = spark.createDataFrame(rows, "id int, repo string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    assert sinks.clustered(df).exceptAll(df).isEmpty() and sinks.clustered(df).count() == 5
    assert sinks.clustered(df.limit(0)).count() == 0


def test_heavy_hitters(spark):
    i = F.col("id")
    df = spark.range(60_000).select(F.when(i % 3 == 0, 1).when(i % 3 == 1, i % 10).otherwise(i + 1000).cast("bigint").alias("v"))
    exact = {r.v: r.n for r in report.value_counts(df, "v").collect()}
    got = report.heavy_hitters(df, "v", 5, tracked=512).collect()
    assert got[0].v == 1 and len(got) == 5
    assert all(abs(r.n - exact[r.v]) <= r.error for r in got) and 0 < got[0].error < 60_000 * 0.01
    few = report.heavy_hitters(df.filter("v < 10"), "v", 3)
    assert [r.n for r in few.collect()] == sorted((n for v, n in exact.items() if v < 10), reverse=True)[:3]
    assert report.heavy_hitters(df.limit(0), "v").count() == 0


def test_bounded_sidecar(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 2 = 0, 'big', concat('s', id)) AS source", "if(id % 4 = 0, null, 'other') AS label", "timestamp_seconds(id) AS created_at"
    )
    meta = report.ingest_meta(df, listed=10).first()
    assert meta.rows == 5000 and meta.source_dist["big"] == 2500 and len(meta.source_dist) == 10
    assert meta.source_rest == 2500 - 9 and meta.label_dist == {"other": 3750, "null": 1250} and meta.label_rest == 0
    assert report.distributions(df).filter("section = 'source'").count() == 2501


def plain_pattern_hits(words, texts):
    return [any(w in t.lower() for w in words) for t in texts]


@pytest.mark.parametrize("match", ["substring", "word"])
def test_many_keywords(spark, match):
    draw = random.Random(2)
    words = sorted({"".join(draw.choices("abcdé.+-[(\\ 1", k=draw.randint(1, 6))).strip() or "z" for _ in range(150)} | {"e", "ab", "abc", "a]b", "^x"})
    words = [w for w in words if len(w) > 1]
    texts = ["".join(draw.choices("ABCDÉé.+-[(\\ 1x]^", k=draw.randint(0, 30))) for _ in range(400)]
    got = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", tx.contains_any(F.col("t"), words, match).alias("h")).orderBy("i").collect()]
    if match == "substring":
        assert got == plain_pattern_hits(words, texts)
    else:
        def whole(w, t):
            at = t.find(w)
            while at >= 0:
                before, after = t[at - 1 : at], t[at + len(w) : at + len(w) + 1]
                if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                    return True
                at = t.find(w, at + 1)
            return False

        assert got == [any(whole(w, t.lower()) for w in words) for t in texts]
    assert any(got) and not all(got)


def test_a_thousand_keywords_in_one_pass(spark):
    """The pattern takes less than half of the time of a search per keyword."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(6, 12))) for _ in range(1000)]
    df = spark.range(0, 3000, 1, 1).select(F.concat_ws(" ", *[F.md5((F.col("id") + k).cast("string")) for k in range(20)]).alias("t"))

    def one_by_one(col):
        hits = [col.contains(w) for w in words]
        while len(hits) > 1:  # a balanced tree: a chain of a thousand is too deep
            hits = [a | b for a, b in zip(hits[::2], hits[1::2], strict=False)] + hits[len(hits) // 2 * 2 :]
        return hits[0]

    took = []
    for test in (F.exists(F.array(F.lower("t")), one_by_one), tx.contains_any(F.col("t"), words)):
        df.filter(test).count()
        start = time.perf_counter()
        df.filter(test).count()
        took.append(time.perf_counter() - start)
    assert took[1] < took[0] / 2, took
