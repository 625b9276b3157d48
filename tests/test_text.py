import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commentflow.functions import labels as lb
from commentflow.functions import text as tx


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_light_norm_cases(spark):
    cases = {
        "a\tb": "a b",
        "a\r\nb": "a\n\nb",
        "a\n\n\n\nb": "a\n\nb",
        "a\u200bb\u200c\u200d\ufeffc": "abc",
        "\u00a0a\u00a0": "a",
        "a\x0bb\x0c c": "a b c",
        "a\nb": "a\nb",
        "a \t  b": "a b",
        "\x1cx\x85": "x",
        "": "",
        None: None,
    }
    assert column(spark, list(cases), tx.light_norm) == list(cases.values())


NOISY = st.text(alphabet="ab \t\n\r\f\x0b\u200b\u00a0\u3000\x1c\x85\u2028\u00e9", max_size=30)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NOISY, min_size=50, max_size=200))
def test_text_properties(spark, values):
    normal = column(spark, values, tx.light_norm)
    again = column(spark, normal, tx.light_norm)
    for before, after in zip(values, normal):
        assert after == after.strip()
        assert not set(after) & set("\t\r\f\x0b\u200b")
        assert "  " not in after and "\n\n\n" not in after
        assert after.split() == before.replace("\u200b", "").split()
    assert again == normal
    assert column(spark, values, tx.has_content) == [v != "" for v in normal]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]
    assert column(spark, values, tx.is_blank) == [not v.strip() for v in values]
    for n in (1, 3, 10):
        assert column(spark, values, lambda c: tx.has_words(c, n)) == [len(v.split()) >= n for v in values]


def test_keywords(spark):
    values = ["Open SOURCE", "memory  leak", None, "a+b", "force", "an RCE here"]
    hits = column(spark, values, lambda c: tx.contains_any(c, [" RCE ", "leak", "memory leak", ""]))
    assert hits == [True, True, False, False, True, True]
    words = column(spark, values, lambda c: tx.contains_any(c, ["rce", "a+b"], match="word"))
    assert words == [False, False, False, True, False, True]
    assert column(spark, values, lambda c: tx.contains_any(c, [" "])) == [True] * 6
    with pytest.raises(ValueError):
        tx.contains_any(F.lit("x"), ["y"], match="fuzzy")


def test_weak_label(spark):
    rows = [
        ("x", "kind/security", "plain"),
        ("x", " Kind/Bug ;other", "plain"),
        ("debug run", None, "plain"),
        ("x", "", "a resource"),
        ("x", "", "CVE-2024-1"),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "title string, labels string, text string")
    got = [r[0] for r in df.select(lb.weak_label(F.col("text"), F.col("title"), F.col("labels"))).collect()]
    assert got == ["security", "bug", "bug", "security", "security", "other"]
    word = df.select(lb.weak_label(F.col("text"), F.col("title"), F.col("labels"), match="word"))
    assert [r[0] for r in word.collect()] == ["security", "bug", "other", "other", "other", "other"]


def test_context_and_labels(spark):
    rows = [(" T ", "a;b"), ("T", ""), (None, "a"), (None, None), ("T", ";;a;")]
    df = spark.createDataFrame(rows, "title string, labels string")
    got = [r[0] for r in df.select(lb.build_context(F.col("title"), F.col("labels"))).collect()]
    assert got == ["T [a][b]", "T", "[a]", "", "T [a]"]
    lists = [r[0] for r in df.select(lb.label_list(F.col("labels"))).collect()]
    assert lists == [["a", "b"], [], ["a"], [], ["a"]]


def test_prefix_and_keys(spark):
    values = ["my GitHub", "reddit.com", "x", None]
    assert column(spark, values, tx.domain_prefix) == ["<GITHUB> ", "<REDDIT> ", "", ""]
    df = spark.createDataFrame([("a::b::c",)], "k string")
    assert df.select(*tx.split_key(F.col("k"))).first()[:] == ("a", "b::c")
    assert column(spark, ["x" * 1500, None], tx.text_sample) == ["x" * 1000, ""]
