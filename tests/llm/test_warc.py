"""Archives written and read back, against plain Python."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from commentflow.llm import warc


def brute(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= min_bytes:
            key = (page is not None, page or 0)
            first[raw] = min(first.get(raw, key), key)
    out, seen = [], set()
    for page, url, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        has, least = first.get(raw, (None, None))
        again = raw in first and ((page is not None, page or 0) != (has, least) or (page, raw) in seen)
        seen.add((page, raw))
        out.append((page, len(raw), digest, "revisit" if again else "response", (least if has else None) if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "u\r\nX-Page-Id: 9", "<p>one</p>"),
    (5, "http://a/é", "É日本\r\n\r\nWARC/1.1\r\n" * 3), (7, "x", "<p>one</p>"), (7, "x", "<p>one</p>"), (None, "n", "only"),
    (None, "n", "É"), (8, "b", "É"), (9, "big", "ab" * 9_000_000), (6, "z", "\0" * 300),
]


def run(spark, rows, folder, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int").repartition(3)
    manifest = warc.write(df, folder, **options)
    return manifest, warc.read(spark, folder, payloads=True)


def test_round_trip(spark, tmp_path):
    rows = ROWS + [(100 + i, f"http://h/{i}", random.Random(i).choice(["same", "x" * i, None])) for i in range(300)]
    manifest, got = run(spark, rows, f"{tmp_path}/w", roll_bytes=3000)
    have = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in have), key=str) == brute(rows)
    payload = {}
    for page, _, html in rows:
        payload.setdefault(page, set()).add((html or "").encode())
    assert all(bytes(r.payload) in payload[r.page_id] for r in have if r.record_type == "response")
    assert len(manifest["files"]) > 3
    for f in manifest["files"]:
        assert gzip.open(f"{tmp_path}/w/{f['name']}").read().startswith(b"WARC/1.1\r\n")


def test_same_bytes_again(spark, tmp_path):
    one, _ = run(spark, ROWS, f"{tmp_path}/a")
    two, _ = run(spark, ROWS[::-1], f"{tmp_path}/b")
    assert one == two
    for f in one["files"]:
        assert (tmp_path / "a" / f["name"]).read_bytes() == (tmp_path / "b" / f["name"]).read_bytes()


def test_small_payloads_are_responses(spark, tmp_path):
    _, got = run(spark, ROWS, f"{tmp_path}/w", min_bytes=5)
    assert sorted((r[0], r[2], r[3], r[4], r[5]) for r in got.filter("page_id < 9").collect()) == [
        r for r in brute(ROWS, 5) if r[0] and r[0] < 9]


def test_missing_file_is_an_error(spark, tmp_path):
    manifest, _ = run(spark, ROWS, f"{tmp_path}/w", roll_bytes=100)
    (tmp_path / "w" / manifest["files"][0]["name"]).unlink()
    with pytest.raises(ValueError):
        warc.read(spark, f"{tmp_path}/w")


def test_empty(spark, tmp_path):
    _, got = run(spark, [], f"{tmp_path}/w")
    assert got.count() == 0


def test_shards_do_not_depend_on_the_run(spark):
    """400,000 ids dealt out differently: the same shards, in id order, of like size."""
    ids = spark.range(400_000).selectExpr("id * 7 AS page_id", "'u' AS url", "cast(id AS string) AS html")
    found = []
    for df in (ids.repartition(3), ids.repartition(11, "page_id")):
        rows = warc._sorted_rows(df, 0).filter("kind = 1").groupBy("shard").agg(
            F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count(F.lit(1)).alias("n"))
        found.append(sorted(map(tuple, rows.collect())))
    assert found[0] == found[1] and len(found[0]) == 32
    assert all(a[2] < b[1] for a, b in zip(found[0], found[0][1:], strict=False))
    assert max(r[3] for r in found[0]) < 1.1 * 400_000 / 32


def test_odd_ids(spark, tmp_path):
    """Crowded, far apart and negative ids, and a third of the rows without one."""
    ids = [-(2**63), 2**63 - 1, 0, *range(10**12, 10**12 + 1500)] + [None] * 700
    rows = [(p, f"u{i}", f"t{i % 900}") for i, p in enumerate(ids)]
    manifest, got = run(spark, rows, f"{tmp_path}/w")
    have = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    assert have == brute(rows)
    assert len(manifest["files"]) > 3
