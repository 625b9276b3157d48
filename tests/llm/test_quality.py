"""The ledger against plain Python, and policies against the ledger."""

import re

import pytest

from commentflow.llm import quality

TEXTS = [
    None, "", " \t\n", "one", "a b c", "a b c a b c", "a b c d\na b c d\n\n \r\na b c d",
    "x " * 60, "x y " * 40 + "z", "Tab\tand\x0bfeed\x0c#x #y <z>", "ÀÉ É! é?   b c d",
    "\r\nq w e r q w e r q w e", " ".join(f"w{i}" for i in range(70)),
    " ".join(f"w{i % 30}" for i in range(5000)),
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    bare = "".join(w)
    return dict(
        n_words=len(w), word_chars=len(bare), n_symbols=sum(c in "#*$%&|<>" for c in bare),
        n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered),
        n_upper=sum(c.isupper() for c in bare), n_marks=bare.count("!") + bare.count("?"),
    )


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[:3])] + [(None, "a b", None, None)]
    return quality.ledger(spark.createDataFrame(data, "doc_id int, text string, _words string, n_words int"))


def test_measures(rows):
    got = {r.doc_id: r.asDict() for r in rows.collect()}
    assert len(got) == len(TEXTS) + 4
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, i


def test_policies_read_bits_only(rows):
    base = quality.apply_policy(rows, quality.POLICIES["base-1"])
    for r in base.collect():
        assert r.kept == (r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words)


def test_ablations(rows):
    policy = quality.POLICIES["prose-1"]
    bits = [r.fail_bits for r in rows.collect()]
    got = {r.rule: r for r in quality.ablations(rows, [policy]).collect()}
    for rule in quality.RULES:
        own = 1 << rule.bit
        r = got[rule.name]
        assert (r.docs, r.failed, r.failed_alone, r.kept, r.kept_without_rule) == (
            len(bits), sum(b & own > 0 for b in bits), sum(b == own for b in bits),
            sum(b == 0 for b in bits), sum(b & ~own == 0 for b in bits),
        )


def test_empty(spark):
    rows = quality.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0
    assert quality.ablations(rows, [quality.POLICIES["base-1"]]).count() == 0
