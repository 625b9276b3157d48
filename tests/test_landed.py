"""The index of landed ids is exact and leaves the other buckets alone."""

import glob
import os

import pytest

from commentflow.operators import state
from commentflow.sources.landed import LandedIndex, append_indexed
from commentflow.streaming import ingest


def frame(spark, ids, kind="string"):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], f"id {kind}, text string")


def ids(df):
    return sorted((r.id for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_appends_equal_a_set(spark, tmp_path, kind):
    def names(span):
        return list(span) if kind == "bigint" else [f"c{i}" for i in span]

    path, index = str(tmp_path / "rows"), LandedIndex(str(tmp_path / "index"), buckets=8)
    seen = set()
    for n, span in enumerate((range(0, 300), range(200, 500), range(100, 120), range(490, 700))):
        fresh = append_indexed(frame(spark, [*names(span), *names(span)[:5]], kind), path, index)
        assert ids(fresh) == sorted(set(names(span)) - seen, key=str)
        seen |= set(names(span))
        if n == 2:
            index.compact(spark)
            index.compact(spark)
    assert ids(spark.read.parquet(path)) == sorted(seen, key=str)
    assert len(index.spans(spark)) > 4 and index.next_append(spark) == 4


def test_other_buckets_are_not_read(spark, tmp_path):
    """Ids of untouched buckets are made unreadable: a lookup does not notice."""
    index = LandedIndex(str(tmp_path / "index"), buckets=32)
    landed = frame(spark, [f"c{i}" for i in range(2000)])
    index.add(landed, 0)
    incoming = frame(spark, ["c7", "new1", "new2"])
    touched = {r.bucket for r in index._placed(incoming, "id").collect()}
    own = {r.bucket for r in index._placed(frame(spark, ["c7"]), "id").collect()}
    for part, keep in (("ids", own), ("marks", touched)):
        for file in glob.glob(f"{index.path}/{part}/low=0/high=0/bucket=*/*.parquet"):
            if int(os.path.basename(os.path.dirname(file)).split("=")[1]) not in keep:
                with open(file, "wb") as out:
                    out.write(b"not parquet")
    spark.catalog.clearCache()
    assert ids(index.unseen(incoming)) == ["new1", "new2"]
    assert ids(index.unseen(incoming)) == ids(state.unseen(incoming, landed))


def test_unfinished_appends_do_not_count(spark, tmp_path):
    """An append that died before its mark is written again by the next one."""
    path, index = str(tmp_path / "rows"), LandedIndex(str(tmp_path / "index"))
    append_indexed(frame(spark, ["a", "b"]), path, index)
    frame(spark, ["x"]).write.parquet(f"{path}/batch_id=1")  # rows without their index
    fresh = append_indexed(frame(spark, ["b", "c"]), path, index)
    assert ids(fresh) == ["c"] and ids(spark.read.parquet(path)) == ["a", "b", "c"]


def test_edges(spark, tmp_path):
    index = LandedIndex(str(tmp_path / "index"))
    rows = frame(spark, [None, "", "a", "a"])
    assert index.landed(rows) is None and index.unseen(rows).count() == 4
    index.add(frame(spark, []), 0)
    assert index.unseen(rows).count() == 4
    index.add(rows, 1)
    assert index.unseen(rows).count() == 1 and index.unseen(rows, before=1).count() == 4
    assert index.unseen(frame(spark, [])).count() == 0


def test_stream_batches(spark, tmp_path):
    out, index = str(tmp_path / "out"), LandedIndex(str(tmp_path / "index"), buckets=4)
    batches = [[f"c{i}" for i in range(0, 40)], [f"c{i}" for i in range(30, 60)], [f"c{i}" for i in range(0, 70, 3)]]
    for n in (0, 1, 1, 2, 2):
        ingest.append_batch(frame(spark, batches[n]), n, out, index=index)
    assert ids(spark.read.parquet(out)) == sorted({i for b in batches for i in b})
