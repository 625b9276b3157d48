"""Limits over several batches against a plain loop; batches that run again."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from commentflow.streaming import ingest
from commentflow.streaming.ledger import Ledger, LedgerSelection

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "id string, repo string, is_pr boolean, issue_number int, comment_type string, "
    "created_at timestamp, container_updated_at timestamp, context_id string, reactions int"
)


def drops(seed, n=5, size=60):
    draw = random.Random(seed)
    out, serial = [], 0
    for _ in range(n):
        rows = []
        for _ in range(size):
            serial += 1
            item = draw.randint(0, 7)
            kind = "issue_body" if draw.random() < 0.1 else "issue_comment"
            repo = None if item == 7 else f"r{item % 3}"
            rows.append((f"c{serial:04}", repo, item % 2 == 1, item, kind, T0 + timedelta(minutes=draw.randint(0, 500)),
                         T0 + timedelta(hours=item), f"{repo}#{item}", draw.randint(0, 3)))
        out.append(rows)
    return out


def plain(batches, k, budget, policy):
    items, sources, out = Counter(), Counter(), []
    for batch in batches:
        comments = [r for r in batch if r[4] == "issue_comment"]
        out += [r[0] for r in batch if r[4] != "issue_comment"]
        order = {"oldest": lambda r: (r[5], r[0]), "most-reacted": lambda r: (-r[8], -r[5].timestamp(), r[0])}[policy]
        offered, room = [], Counter(items)
        for r in sorted(comments, key=order):
            if k is None or room[r[7]] < k:
                room[r[7]] += 1
                offered.append(r)
        for r in sorted(offered, key=lambda r: (r[2], -r[6].timestamp(), r[3], order(r))):
            if budget is None or sources[r[1]] < budget:
                sources[r[1]] += 1
                items[r[7]] += 1
                out.append(r[0])
    return sorted(out)


@pytest.mark.parametrize("k, budget, policy", [(2, None, "oldest"), (3, 7, "most-reacted"), (None, 9, "oldest"), (1, 0, "oldest")])
def test_limits_over_batches(spark, tmp_path, k, budget, policy):
    batches = drops(k or 5)
    ledger = Ledger(str(tmp_path / "ledger"), every=2)
    choose = LedgerSelection(ledger, k, policy, budget)
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2 if n in (1, 3) else 1):  # some batches run twice
            ingest.append_batch(batch, n, str(tmp_path / "out"), choose=choose)
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain(batches, k, budget, policy)
    taken = {(r.scope, r.key): r.n for r in ledger.taken(spark, len(batches)).collect()}
    assert sum(n for (scope, _), n in taken.items() if scope == "item") == sum(i.startswith("c") for i in got) - sum(
        r[4] != "issue_comment" for b in batches for r in b
    )
    if k:
        assert max([n for (scope, _), n in taken.items() if scope == "item"], default=0) <= k


def test_old_deltas_are_not_opened(spark, tmp_path):
    ledger = Ledger(str(tmp_path), every=2)
    for n in range(5):
        ledger.record(spark.createDataFrame([("item", "a", 1)], "scope string, key string, n long"), n)
    files = ledger.taken(spark, 5).inputFiles()
    assert ledger.taken(spark, 5).collect()[0].n == 5 and ledger.taken(spark, 2).collect()[0].n == 2
    assert files and ledger.taken(spark, 0).count() == 0


def test_a_stream_of_drops(spark, tmp_path):
    batches = drops(9, 3)
    dirs = {n: str(tmp_path / n) for n in ("in", "out", "progress", "ledger")}
    choose = LedgerSelection(Ledger(dirs["ledger"]), 2, "oldest", 6)
    from pyspark.sql.types import StructType

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(dirs["in"])
        stream = ingest.stream_files(spark, dirs["in"], StructType.fromDDL(SCHEMA))
        ingest.start_ingest(ingest.dedupe_stream(stream), dirs["out"], dirs["progress"], choose=choose).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(dirs["out"]).collect()) == plain(batches, 2, 6, "oldest")
