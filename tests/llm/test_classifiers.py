"""Language identification and toxicity: held-out accuracy and edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commentflow.llm import langid, queries, sampling, toxicity

SF = "/root/testdata/sf0.01"


def test_grams_against_plain_python():
    texts = ["Hello  World", None, "", "É!a", "x"]
    h, at = langid.grams(pa.array(texts))

    def plain(text):
        raw = bytes(b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in (text or "").encode())
        raw = b"  " + raw + b"  "
        parts = [raw[i : i + 5] for i in range(len(raw) - 4)]
        return [p for p in parts if b"  " not in p[1:4] and not (p[:2] == b"  " and p[3:] == b"  ")]

    for i, text in enumerate(texts):
        assert len(set(h[at == i].tolist())) == len(set(plain(text))), text


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    got = queries.op10_langid(spark, SF).join(docs, "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("true")).cast("int"))).first()[0]
    assert got.count() == docs.count() and share > 0.95
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_languages_against_plain_python(spark):
    """Slots, counts, correction and choice, gram by gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(400)
    rows = docs.collect()
    learning = [r for r in rows if r.doc_id % 3 and r.lang != "fr"] + [r for r in rows if r.lang == "fr"][:5]
    frame = spark.createDataFrame(learning, docs.schema)
    languages = sorted({r.lang for r in learning})

    def hashes(text):
        return langid.grams(pa.array([text.lower()]))[0].tolist()

    slots, share = {}, []
    for bit, lang in enumerate(languages):
        texts = {r.text for r in learning if r.lang == lang}
        seen = {}
        for text in texts:
            for g in set(hashes(text)):
                seen[g] = seen.get(g, 0) + 1
        own = set()
        for g, n in seen.items():
            if n > 1 or len(texts) < langid.FEW:
                own |= {g & langid.SLOTS - 1, g >> 32 & langid.SLOTS - 1}
        for k in own:
            slots[k] = slots.get(k, 0) | 1 << bit
        share.append(len(own) / langid.SLOTS)
    model = langid.learn(frame)
    assert model[0] == languages
    for k, mask in slots.items():
        assert int(model[1][0, k]) == mask
    got = {r.doc_id: r for r in langid.predict(docs.limit(120), model).collect()}
    for r in rows[:120]:
        if r.doc_id not in got or not any(c.isalpha() for c in r.text or ""):
            continue
        grams = hashes(r.text)
        true = []
        for bit in range(len(languages)):
            hits = sum(slots.get(g & langid.SLOTS - 1, 0) & slots.get(g >> 32 & langid.SLOTS - 1, 0) & 1 << bit != 0 for g in grams)
            false = share[bit] ** 2
            true.append((hits / max(len(grams), 1) - false) / (1 - false))
        best = max(range(len(languages)), key=lambda b: (true[b], -b))
        assert got[r.doc_id].lang_pred == languages[best]
        assert abs(got[r.doc_id].score - min(max(true[best], 0), 1)) < 1e-9


def test_language_edge_cases(spark):
    rows = [("aa bb cc dd " * 5, "xx")] * 3 + [("zz yy ww vv " * 5, "yy")] * 3 + [(None, "xx"), ("12", None)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model[0] == ["xx", "yy"]
    odd = [(1, None), (2, ""), (3, "12 !"), (4, "aa bb cc"), (5, "WW VV zz"), (5, "WW VV zz"), (None, "aa bb " * 200000)]
    got = langid.predict(spark.createDataFrame(odd, "doc_id int, text string"), model).collect()
    assert sorted(((r.doc_id or 0), r.lang_pred) for r in got) == [
        (0, "xx"), (1, "und"), (2, "und"), (3, "und"), (4, "xx"), (5, "yy"), (5, "yy")]
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert langid.predict(spark.createDataFrame(odd, "doc_id int, text string"), none).select("lang_pred").distinct().collect() == [("und",)]


def test_toxicity_held_out(spark):
    folder = SF + "/../sf0.1"  # the smaller tables have too few labels to learn from
    got = queries.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = got.filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 0), 0) + n.get((1, 1), 0))
    assert n.get((0, 1), 0) <= 0.02 * n[(0, 0)]


def model_of(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, toxic int")
    return toxicity.learn(df.drop("toxic"), df.drop("text"), **options)


def test_pairs_beyond_single_terms(spark):
    """Label 1 for exactly one of two words: no sum of single weights tells it."""
    rng = np.random.default_rng(0)
    rows = []
    for a, b in (rng.random((1500, 2)) < 0.5).tolist():
        other = [f"w{k}" for k in rng.integers(0, 60, 8)]
        rows.append((" ".join(other + ["kado"] * int(a) + ["zemi"] * int(b)), int(a ^ b)))
    model = model_of(spark, rows, epochs=20)
    new = [(k, " ".join([f"w{k}", f"w{k + 9}", *words])) for k, words in enumerate([[], ["kado"], ["zemi"], ["kado", "zemi"]] * 5)]
    got = toxicity.score(spark.createDataFrame(new, "doc_id int, text string"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 in (1, 2)) for r in got), got


def test_scores_against_plain_python(spark):
    """Every pair of terms summed one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    place = {t: i for i, t in enumerate(model["terms"].tolist())}
    rows = docs.limit(80).collect()
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, docs.schema), model).collect()}
    for r in rows:
        h, _ = toxicity.terms(pa.array([r.text]))
        own = [place[t] for t in set(h.tolist()) if t in place]
        z = model["bias"] + sum(model["w"][i] for i in own)
        z += sum(float(model["v"][i] @ model["v"][j]) for k, i in enumerate(own) for j in own[:k])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


@pytest.mark.parametrize("rows", [[], [("good words here", 0)] * 3, [(None, 1), ("", 1), ("x y", None)]])
def test_toxicity_edge_cases(spark, rows):
    model = model_of(spark, rows)
    odd = [(1, None, "a"), (2, "", "b"), (None, "stupid " * 100000, None), (3, "x", ""), (3, "x", "")]
    df = spark.createDataFrame(odd, "doc_id int, text string, `_scored` string").selectExpr("*", "1 AS score", "2 AS terms")
    got = toxicity.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert rows or {r.score for r in got} == {0.5}
    with pytest.raises(ValueError):
        toxicity.score(df, model, keep=("score",))


def test_sample_of_copies(spark):
    """A text in most rows takes one place; the choice does not depend on the order."""
    rows = [("same text", 0)] * 3000 + [(f"text {i}", i % 2) for i in range(500)] + [("same text", 1)] * 1000
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, k int")

    def chosen(table, most):
        once = sampling.hashes(table, "text", F.lit(0).alias("k")).distinct()
        return sorted(r.text for r in sampling.texts_of(table, "text", sampling.fewest(once, most)).collect())

    assert len(chosen(df, 100)) == len(set(chosen(df, 100))) == 100
    assert chosen(df, 100) == chosen(df.orderBy(F.desc("id")).repartition(7), 100)
    assert len(chosen(df, 1000)) == 501
