"""Winnowed hits against a plain search of every window in every document."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from commentflow.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(len(v), 10)
            known = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in known:
                    hit |= set(range(s, s + n))
                    held |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(held), digest, bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, extra=""):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS hits", "2 AS n", "3 AS items")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "'x' AS hash", "4 AS `set`")
    got = winnow.decontaminate(a.repartition(4), b)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def compare(spark, docs, items):
    assert run(spark, docs, items) == plain(docs, items)


def test_small_vocabulary(spark):
    """Few words, so that windows, hashes and places coincide often."""
    draw = random.Random(5)
    text = [" ".join(draw.choices("ab", k=draw.randint(0, 40))) for _ in range(150)]
    compare(spark, [(i, t) for i, t in enumerate(text[:120])], [(i, t) for i, t in enumerate(text[120:])])
    wide = [" ".join(draw.choices([f"w{i}" for i in range(9)], k=draw.randint(0, 300))) for _ in range(60)]
    cut = [(i, " ".join(wide[i].split()[5 * i % 40 :][: draw.randint(1, 30)])) for i in range(25)]
    compare(spark, list(enumerate(wide)), cut)


def test_edges(spark):
    base = "One two, THREE four-five 6 seven ÄÖ eight nine ten Eleven twelve"
    docs = [
        (1, None), (2, ""), (3, " .,;\n"), (None, base), (4, base), (4, base), (4, "ten " * 9), (5, base.upper().replace("ÄÖ", "äö")),
        (6, base.replace(" ", "\x00")), (7, "x " * 5000 + base + " y" * 300000), (8, base + " " + base), (9, "日本 " + base[:40]),
        (10, "alone"), (11, "twelve ten alone"),
    ]
    compare(spark, docs, [(1, base), (2, base), (2, "alone"), (None, "日本"), (3, None), (4, ""), (5, "ten ten"), (10, "Twelve TEN")])
    compare(spark, docs, [(1, None)])
    compare(spark, [], [(1, base)])
    compare(spark, docs, [])


def test_common_passage(spark):
    """A passage in a third of all rows and in all items."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"d{i} start " + (passage if i % 3 == 0 else "none") + f" end {i}") for i in range(600)]
    items = [(i, f"q{i} {passage}") for i in range(30)]
    assert run(spark, docs, items) == plain(docs, items)


def test_documents(spark):
    read = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect() for t in ("documents", "benchmark")}
    items = [(r.item_id, r.text) for r in read["benchmark"]]
    compare(spark, [(r.doc_id, r.text) for r in read["documents"]][:60], items)


def test_density():
    """Winnowing keeps about 2 in 7 runs and never misses a span."""
    draw = np.random.default_rng(3)
    text = " ".join(map(str, draw.integers(0, 10**6, 20000)))
    count, found = winnow.fingerprints(pa.array([text]), [10], False, None)
    assert count == [20000]
    assert 0.25 < len(found[0]) / 20000 < 0.32
    starts = [s for h in found[0] for s in range(h["start"], h["start"] + len(h["words"]) - 9)]
    assert starts == list(range(20000 - 9))
