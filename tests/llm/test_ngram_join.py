"""The join against all pairs compared in plain Python."""

import random
import re

import pytest

from commentflow.llm import ngram_join


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None) for i, t in rows), key=str)


def edited(words, share, rng):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [None, "", " \n", "One two", "one TWO", "one two\tthree four", "É é é é é é", "é é é é é é"]
    for n in (6, 8, 9, 12, 40, 120, 400):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
        for share in (0, 0, .005, .01, .02, .03, .04, .05):
            out.append(edited(base, share, rng))
        for cut in range(1, 5):
            out.append(" ".join(base[:-cut]))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"u{k}_{i}" for i in range(5 + k)) for k in range(30)]
    out.append(" ".join(f"long{i % 7000}" for i in range(20000)))
    ids = list(range(100, 100 + len(out)))
    rng.shuffle(ids)
    return [*zip(ids, out, strict=True), (None, "no id here at all"), (ids[5], out[5])]


def check(spark, rows, percent=80):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, doc int, name string")
    got = ngram_join.join(df.repartition(3), percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, percent)


def test_against_all_pairs(spark, rows):
    check(spark, rows)


def test_small_blocks_and_other_threshold(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    check(spark, rows, 70)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
