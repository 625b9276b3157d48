import pytest
from pyspark.sql import functions as F

from commentflow.constants import MAX_LEN
from commentflow.functions import tokens as tk
from commentflow.operators import pooling, report, windows

OPTIONS = dict(max_len=12, overlap=4, special=2)  # content 10, step 6


def docs(spark, sizes):
    rows = [(str(n), "s", " ".join(f"w{i}" for i in range(n)), "en") for n in sizes]
    return spark.createDataFrame(rows, "id string, split string, text string, label string")


@pytest.mark.parametrize("cap", [None, 2])
def test_windows_cover_the_text(spark, cap):
    sizes = [0, 1, 10, 11, 16, 17, 40, 999]
    df = docs(spark, sizes)
    cut = windows.explode_windows(df, max_windows=cap, **OPTIONS)
    got = {}
    for r in cut.orderBy("window_no").collect():
        assert len(r.attention_mask) == len(r.tokens) <= 10
        got.setdefault(int(r.id), []).append(r.tokens)
    counts = {
        int(r.id): r.n_windows
        for r in windows.with_window_count(df, max_windows=cap, **OPTIONS).collect()
    }
    for n in sizes:
        parts = got[n]
        assert len(parts) == counts[n]
        assert cap is None or len(parts) <= cap
        words = [f"w{i}" for i in range(n)]
        for no, part in enumerate(parts):
            assert part == words[no * 6:no * 6 + 10]
        if cap is None:
            rebuilt = parts[0] + [w for p in parts[1:] for w in p[4:]]
            assert rebuilt == words
            assert len(parts) == 1 or len(parts[-1]) > 4


def test_truncate_and_limits(spark):
    df = docs(spark, [0, 3, 30])
    cut = windows.explode_windows(df, sliding=False, **OPTIONS)
    assert sorted(len(r.tokens) for r in cut.collect()) == [0, 3, 10]
    assert sorted(r.id for r in windows.drop_long(df, 5).collect()) == ["0", "3"]
    limited = windows.explode_windows(df, max_windows=None, max_input_tokens=5, **OPTIONS)
    assert {r.id for r in limited.collect()} == {"0", "3"}
    for bad in (dict(max_len=2), dict(max_len=12, overlap=10), dict(overlap=-1)):
        with pytest.raises(ValueError):
            tk.token_windows(F.array(), **{"max_len": MAX_LEN, "special": 2, **bad})


def test_windows_need_no_shuffle(spark):
    plan = windows.explode_windows(docs(spark, [5]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_profile(spark):
    out = report.length_profile(docs(spark, range(101)), tk.token_length(tk.tokenize(F.col("text")))).first()
    assert (out.n_rows, out["mean"], out["min"], out.p50, out.p90, out["max"]) == (101, 52, 2, 52, 92, 102)
    assert out.std == pytest.approx(29.300170647967224)
    assert report.length_profile(docs(spark, [4]), F.lit(3)).first().std is None


def test_weights_and_dictionary(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("b", 1), (None, 9)], "label string, n int")
    got = {r.label: (r.label_id, r.n_rows, r.weight) for r in windows.class_weights(df, count=F.col("n")).collect()}
    assert got == {"a": (0, 1, 2.5), "b": (1, 4, 0.625)}
    names = windows.label_dictionary(df)
    ids = windows.with_label_id(df, names)
    assert sorted((r.label, r.label_id) for r in ids.collect()) == [("a", 0), ("b", 1), ("b", 1)]
    back = windows.with_label_text(ids.select("label_id"), names)
    assert sorted(r.label for r in back.collect()) == ["a", "b", "b"]
    weighted = windows.weight_column(windows.class_weights(df.filter("label = 'a'")), df)
    assert sorted((r.label or "", r.weight) for r in weighted.collect()) == [("", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)]


def test_reports(spark):
    df = spark.createDataFrame(
        [("1", "t", "a", "g", "c", "r1"), ("2", "t", None, "g", "c", "r1"), ("3", "t", "a", "h", "c", "r2"), ("4", "t", "a", "h", "c", None)],
        "id string, text string, label string, source string, context_id string, repo string",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r.label: r.n for r in report.value_counts(df, "label").collect()} == {"a": 3, None: 1}
    assert report.top_values(df, "repo", 1).collect() == [("r1", 2)]
    meta = report.ingest_meta(df).first()
    assert meta.rows == 4 and meta.label_dist == {"a": 3, "null": 1} and meta.source_dist == {"g": 2, "h": 2}
    assert len(meta.columns_present) == 6 and len(meta.created_at_range) == 2
    assert report.ingest_meta(df.limit(0)).first().rows == 0
    split_meta = report.split_meta(df.withColumn("split", F.col("source")), (0.7, 0.2, 0.1)).first()
    assert split_meta.counts == {"g": 2, "h": 2} and split_meta.ratios == [0.7, 0.2, 0.1]


def test_plugged_in_tokenizer(spark):
    class Characters:
        def load(self):
            return lambda text: [c for c in text if c != " "]

    df = docs(spark, [2, 0])
    cut = windows.explode_windows(df, tokenize=pooling.pandas_tokenize(Characters()), **OPTIONS, max_windows=None)
    assert sorted("".join(r.tokens) for r in cut.collect()) == ["", "w0w1"]


def test_texts_are_split_once(spark):
    """No filter may repeat the tokenizer or the normaliser below its column."""
    from commentflow.plans import flows

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id AS id", "text", "lang AS label", "source", "timestamp_seconds(doc_id) AS created_at",
        "source AS context_id", "'train' AS split",
    )

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    prepared = flows.prepare(df, flows.WindowOptions(max_input_tokens=50))
    for frame in (prepared.windows, prepared.weights, prepared.expansion):
        assert plan(frame).count("split(") == 1
    merged = flows.ingest([df.drop("label", "split")], "2024-02-01 00:00:00")
    assert plan(merged).count("trim(regexp_replace(") == 1
    docs, cut = {r.id for r in df.collect() if len(r.text.split()) + 2 <= 50}, prepared.windows
    assert {r.id for r in cut.select("id").distinct().collect()} == docs
    total = prepared.expansion.first()
    assert (total.n_docs, total.n_windows) == (df.count(), cut.count())


def test_prepare_keeps_every_token(spark):
    from commentflow.plans import flows

    docs = spark.createDataFrame(
        [(str(n), " ".join(f"t{i}" for i in range(n)), "bug", "s", "2024-01-01", "c", "train") for n in (5000, 9000)],
        "id string, text string, label string, source string, created_at string, context_id string, split string",
    )
    seen = flows.prepare(docs).windows.select("id", F.explode("tokens").alias("t")).groupBy("id").agg(
        F.count_distinct("t").alias("n")
    )
    assert {r.id: r.n for r in seen.collect()} == {"5000": 5000, "9000": 9000}
