"""The manifest against plain recursion over whole groups."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from commentflow.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def climb(hashes):
    """Root of a run of digests, and per digest its siblings from below."""
    paths, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for path, p in zip(paths, place, strict=True):
            run = p - p % 8
            path.append((hashes[run:p], hashes[p + 1 : run + 8]))
        hashes = [sha(*hashes[k : k + 8]) for k in range(0, len(hashes), 8)]
        place = [p // 8 for p in place]
    return hashes[0] if hashes else None, paths


def plain(rows):
    """(doc_id, source, lang, n_chars, text) rows to the expected output rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], plain_leaf(*row), row))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    subs = []
    for key in keys:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs.append(climb([leaf for _, leaf, _ in groups[key]]))
    root, above = climb([s for s, _ in subs])
    out = []
    for key, (sub, paths), upper in zip(keys, subs, above, strict=True):
        for (doc, leaf, row), path in zip(groups[key], paths, strict=True):
            now = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and row[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                now = plain_leaf(*row[:4], lowered)
            for left, right in path + upper:
                now = sha(*left, now, *right)
            proof = sha(*[h for left, right in path + upper for h in left + right])
            out.append((doc, leaf, sub, root, proof, now, now == root))
    return out


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, f"doc_id long, source string, lang string, n_chars long, text string{extra}")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = merkle.manifest(
        df.repartition(5), altered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
        shown=F.translate("text", upper, upper.lower()),
    )
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def compare(spark, rows):
    def order(found):
        return sorted(found, key=repr)

    assert order(run(spark, rows)) == order(plain(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 512, 513, 1200])
def test_one_group(spark, n):
    compare(spark, [(i * 7 - 40, "s", "en", i, f"Text {i}") for i in range(n)])


def test_many_groups(spark):
    rows = [(i, None, f"l{i % 70}", None, f"Ä {i}") for i in range(300)]
    compare(spark, rows + [(5000 + i, "S", "L", 1, "B") for i in range(600)])


def test_edges(spark):
    odd = [
        (1, None, None, None, None), (None, "a", None, 3, "X"), (None, "a", None, 3, "X"), (None, "b", "en", 3, ""),
        (2, "", "", 0, ""), (3, "é", "é", -5, "Long Text " * 200000), (3, "é", "é", -5, "other"), (3, "é", "é", -5, "other"),
        (4, "1:a", "en", 2, "-"), (6, "s", "en", 2, "a\x00B\n"),
    ]
    compare(spark, odd)


def test_clashing_columns(spark):
    rows = [(i, "s", "en", i, f"T{i}", 1, "x", 2, 3, 4) for i in range(20)]
    got = run(spark, rows, ", pos int, leaf string, tree int, id int, `group` int")
    assert sorted(got, key=repr) == sorted(plain([r[:5] for r in rows]), key=repr)
    assert {r[6] for r in got} == {True, False}
