import json

from pyspark.sql import functions as F

from commentflow import jobs
from commentflow.constants import GITHUB_COLUMNS
from commentflow.operators import model, windows
from commentflow.plans import flows
from commentflow.sources.versions import read_version

NOW = "2024-02-01 00:00:00"


def container(number, pr, comments, title="A crash", updated="2024-01-20T00:00:00Z", threads=()):
    def node(i, day, reactions=0):
        return {
            "id": i, "url": "u", "bodyText": f"text {i}", "createdAt": f"2024-01-{day:02d}T00:00:00Z",
            "author": {"login": "me"}, "reactionGroups": [{"content": "X", "users": {"totalCount": reactions}}],
        }

    return {
        "number": number, "title": title, "url": "cu", "state": "OPEN", "createdAt": "2024-01-05T00:00:00Z",
        "updatedAt": updated, "author": {"login": "op"}, "labels": {"nodes": [{"name": "kind/bug"}]},
        "bodyText": "body", "comments": {"nodes": [node(*c) for c in comments]},
        "reviewThreads": {"nodes": [{"id": "t", "comments": {"nodes": [node(*c) for c in threads]}}]} if pr else None,
    }


PAGES = [
    {"repo": "o/r", "is_pr": False, "nodes": [
        container(1, False, [("a", 6), ("b", 7, 5), ("c", 8)]),
        container(2, False, [("d", 9)], updated="2024-01-25T00:00:00Z"),
        container(3, False, [("e", 9)], title="Question"),
    ]},
    {"repo": "o/r", "is_pr": True, "nodes": [container(4, True, [("f", 6)], threads=[("g", 7)])]},
    {"repo": "no/no", "is_pr": False, "nodes": [container(1, False, [("z", 6)])]},
]


def put(path, records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def run(spark, *argv):
    jobs.main([str(a) for a in argv], spark)


def landed(spark, out):
    return sorted(r.comment_id.rsplit("_", 1)[1] for r in spark.read.parquet(str(out)).collect())


def test_extract_issues(spark, tmp_path):
    pages, names = put(tmp_path / "p.jsonl", PAGES), tmp_path / "names.txt"
    names.write_text("# kept\no/r\n")
    common = ["--pages", pages, "--sources-file", names, "--now", NOW, "--title-keywords", "CRASH "]
    out = tmp_path / "budget"
    run(spark, "extract-issues", *common, "--out", out, "--max-per-item", 2, "--max-per-source", 3,
        "--selection", "most-reacted", "--reviews")
    assert landed(spark, out) == ["b", "c", "d"]
    # The same run again finds c and b landed and takes the next by budget.
    run(spark, "extract-issues", *common, "--out", out, "--max-per-item", 2, "--max-per-source", 1, "--reviews")
    assert landed(spark, out) == ["a", "b", "c", "d"]
    both = tmp_path / "both"
    run(spark, "extract-issues", *common, "--out", both, "--include", "both", "--max-per-item", 1, "--reviews", "--state", tmp_path / "st")
    assert landed(spark, both) == ["a", "d", "f", "o/r#1", "o/r#2", "o/r#4"]
    state = read_version(spark, str(tmp_path / "st")).first()
    assert (state.source, str(state.newest_ts), str(state.oldest_ts)) == ("o/r", "2024-01-09 00:00:00", "2024-01-05 00:00:00")
    # Newer than the state: nothing is left.
    run(spark, "extract-issues", *common, "--out", both, "--mode", "newer", "--state", tmp_path / "st")
    assert len(landed(spark, both)) == 6
    run(spark, "extract-issues", *common, "--out", tmp_path / "none", "--include", "bodies", "--max-per-item", 0)
    assert landed(spark, tmp_path / "none") == ["o/r#1", "o/r#2", "o/r#4"]


def test_extract_posts(spark, tmp_path):
    def reply(i, score, parent="t3_p", body="fine", day=10):
        return {"id": i, "parent_id": parent, "body": body, "score": score, "created_utc": 1704067200.0 + day * 86400}

    post = {
        "subreddit": "s", "id": "p", "title": "Crash", "selftext": "leak here", "permalink": "/p", "created_utc": 1704499200.0,
        "comments": [reply("a", 1), reply("b", 5), reply("c", 9, "t1_a"), reply("d", 9, body="[deleted]"), reply("e", 9, day=90), reply("f", 3)],
    }
    old = {**post, "id": "o", "created_utc": 1600000000.0, "comments": [reply("g", 9)]}
    pages = put(tmp_path / "p.jsonl", [post, {**post, "id": "q", "title": "None"}, old])
    out = tmp_path / "out"
    argv = ["extract-posts", "--pages", pages, "--out", out, "--now", NOW, "--title-keywords", "crash",
            "--body-keywords", "leak", "--max-per-item", 2, "--include", "both"]
    run(spark, *argv)
    ids = sorted(r.comment_id for r in spark.read.parquet(str(out)).collect())
    assert ids == ["b", "f", "reddit_postbody_p"]
    run(spark, *argv)
    ids = sorted(r.comment_id for r in spark.read.parquet(str(out)).collect())
    # Only new replies count, so the second run takes the next one.
    assert ids == ["a", "b", "f", "reddit_postbody_p"]


def test_backfill(spark):
    posts = spark.createDataFrame(
        [("s", i, day * 86400.0) for i, day in (("p", 10), ("q", 20), ("r", 30))], "subreddit string, id string, created_utc double"
    ).selectExpr("*", "'t' AS title", "'' AS selftext", "'a' AS author", "'/x' AS permalink",
                 "array(named_struct('id', concat('c', id), 'parent_id', 't1_x', 'body', 'b', 'author', 'a',"
                 " 'permalink', '/y', 'score', 1L, 'created_utc', created_utc)) AS comments")
    state = spark.sql("SELECT 's' AS source, timestamp_seconds(30 * 86400) AS oldest_ts")
    got = flows.backfill_posts(posts, state, "1970-01-15 00:00:00")
    assert [r.comment_id for r in got.collect()] == ["cq"]


def csv_line(i, kind, author, text, labels="", title="T"):
    cells = ["o/r", "False", str(i % 40), "issue_comment", f"c{i}", f"2024-01-{1 + i % 28:02d}T{i % 24:02d}:00:00Z", author, text,
             "https://github.com/x", f"o/r#issue:{i % 40}", title, "OPEN", "", "", "", labels]
    assert len(cells) == len(GITHUB_COLUMNS) and kind
    return ",".join(f'"{c}"' if c == text else c for c in cells)


WORDS = "this text has more than ten words in it for the filter"


def test_prepare_train_evaluate(spark, tmp_path):
    lines = [",".join(GITHUB_COLUMNS)]
    for i in range(240):
        text = WORDS + (" overflow exploit payload" if i % 3 == 0 else " layout colour theme")
        lines.append(csv_line(i, "x", "me", text, title="bug in it" if i % 3 == 1 else "T"))
    lines.append(csv_line(0, "x", "me", "what comes later under an id"))
    lines.append(csv_line(900, "x", "dependabot[bot]", WORDS))
    lines.append(csv_line(901, "x", "me", "too short"))
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    merged, meta = tmp_path / "merged", tmp_path / "meta"
    run(spark, "ingest", "--inputs", tmp_path / "in.csv", "--out", merged, "--out-meta", meta, "--now", NOW,
        "--apply-noise-filter", "--build-core-schema", "--drop-empty-text")
    record = spark.read.json(str(meta)).first()
    assert record.rows == 240
    assert record.label_dist.asDict() == {"bug": 80, "other": 80, "security": 80}
    assert record.source_dist.asDict() == {"github": 240}
    run(spark, "report", "--input", merged)
    run(spark, "split", "--input", merged, "--out", tmp_path / "split", "--out-meta", tmp_path / "split_meta")
    assert spark.read.json(str(tmp_path / "split_meta")).first().counts.asDict() == {"train": 168, "dev": 36, "test": 36}
    run(spark, "windows", "--input", tmp_path / "split", "--out", tmp_path / "w", "--max-len", 10, "--overlap", 3,
        "--filter-max-input-tokens", 100)
    cut = spark.read.parquet(str(tmp_path / "w" / "windows"))
    # Fourteen or fifteen words at eight per window and a step of five: three.
    assert cut.groupBy("id").count().agg(F.min("count"), F.max("count")).first()[:] == (3, 3)
    weights = spark.read.parquet(str(tmp_path / "w" / "class_weights"))
    train = cut.filter("split = 'train'")
    direct = {r.label: (r.n_rows, r.weight) for r in windows.class_weights(train).collect()}
    assert direct == {r.label: (r.n_rows, r.weight) for r in weights.collect()}
    pre = spark.read.json(str(tmp_path / "w" / "preprocess_meta")).first()
    assert pre.counts.asDict() == {r.split: r["count"] for r in cut.groupBy("split").count().collect()}
    assert pre.label_to_id.asDict() == {"bug": 0, "other": 1, "security": 2}
    run(spark, "train", "--input", tmp_path / "w", "--out", tmp_path / "m", "--features", 256, "--iterations", 10, "--reg", 0.01, 10.0)
    run(spark, "evaluate", "--input", tmp_path / "w", "--model", tmp_path / "m", "--out", tmp_path / "e", "--target-precision", 0.9)
    metrics = {r.split: r for r in spark.read.parquet(str(tmp_path / "e" / "metrics")).collect()}
    assert metrics["dev"].f1 == 1 and metrics["test"].f1 == 1
    dev = spark.read.option("header", True).csv(str(tmp_path / "e" / "outcomes")).filter("split = 'dev'")
    assert dev.count() == 36 and {r.type for r in dev.collect()} == {"TP", "TN"}
    threshold = spark.read.json(str(tmp_path / "e" / "threshold")).first()
    assert threshold.precision_at_threshold == 1 and threshold.recall_at_threshold == 1
    (tmp_path / "items.jsonl").write_text('{"text": ""}\n{"text": "overflow exploit payload"}\n{"text": null}\n')
    common = ["--windows", tmp_path / "w", "--model", tmp_path / "m", "--threshold", tmp_path / "e" / "threshold"]
    run(spark, "score", *common, "--input", tmp_path / "items.jsonl", "--out", tmp_path / "answers")
    answers = sorted(spark.read.parquet(str(tmp_path / "answers")).collect(), key=lambda r: r.score_security)
    assert [(r.id, r.best_snippet) for r in answers] == [(None, ""), (None, ""), (None, "overflow exploit payload")]
    assert answers[0].class_probs == {} and answers[0].band == "low" and answers[0].score_security == 0
    assert answers[2].is_security and answers[2].band == "high" and set(answers[2].version) == {"model_dir", "threshold"}
    (tmp_path / "docs.parquet").symlink_to(tmp_path / "split")
    run(spark, "score", *common, "--input", tmp_path / "docs.parquet", "--out", tmp_path / "all", "--max-len", 10, "--overlap", 3)
    scored = spark.read.parquet(str(tmp_path / "all"))
    both = scored.join(dev.selectExpr("id", "score_security AS s"), "id")
    assert both.count() == 36 and both.filter("abs(score_security - s) > 1e-9").count() == 0


def test_ingest_several_layouts(spark):
    reddit = spark.createDataFrame([("s", "p", "r1", "1704067200", "an exploit")],
                                   "subreddit string, submission_id string, comment_id string, comment_created_utc string, comment_body string")
    github = spark.createDataFrame([("g1", "text\tone", "2024-01-02T00:00:00Z", "debug", "", "https://github.com/x"), ("g2", " ", None, "", "", "")],
                                   "comment_id string, text string, comment_created_at string, container_title string, container_labels string, comment_url string")
    labelled = spark.createDataFrame([("x1", "an exploit", "keep", 1704067200)], "id string, text string, label string, created_at long")
    got = {r.id: r for r in flows.ingest([reddit, github, labelled], NOW).collect()}
    assert set(got) == {"r1", "g1", "x1"}
    assert (got["r1"].label, got["g1"].label, got["x1"].label) == ("security", "bug", "keep")
    assert got["g1"].text == "text one" and got["g1"].context == "debug"
    assert str(got["r1"].created_at) == "2024-01-01 00:00:00" == str(got["x1"].created_at)
    assert got["r1"].source == "reddit" and got["r1"].context_id == "reddit#post:p"


def test_best_candidate(spark):
    rows = [(["good", "x"], 0, 1.0), (["bad", "x"], 1, 2.0)] * 8
    df = spark.createDataFrame(rows, "tokens array<string>, label_id long, weight double")
    grid = [model.Params(64, reg=1e6, elastic=1.0), model.Params(64, 0.01), model.Params(64, 0.1), model.Params(64, 0.2), model.Params(64, 0.3)]
    choice = model.fit_best(df, df, grid, 1)
    assert choice.params.reg == 0.01 and choice.metrics["security_f1"] == 1


def test_merged_sketches(spark):
    """Profiles of any days together, from stored sketches."""
    from commentflow.operators import report

    df = spark.range(30_000).selectExpr("id % 3 AS day", "cast(pow(id % 1000, 2) AS bigint) AS v", "id")
    sketches = report.length_sketches(df.withColumn("v", F.expr("if(id = 7, null, v)")), F.col("v"), ("day",))
    got = report.merged_profile(sketches).first()
    assert got.n_rows == 29_999 and got.min == 0 and got.max == 999**2
    for name, p in (("p50", 0.5), ("p99", 0.99)):
        assert abs(got[name] ** 0.5 / 1000 - p) < 2 * report.SKETCH_ERROR + 0.001
    exact = report.length_profile(df.filter("id <> 7"), F.col("v")).first()
    assert abs(got["mean"] / exact["mean"] - 1) < 1e-12 and abs(got["std"] / exact["std"] - 1) < 1e-9
    part = report.merged_profile(sketches.filter("day < 2"), ("day",))
    assert sorted(r.day for r in part.collect()) == [0, 1]
    assert report.merged_profile(sketches.filter("day > 5"), ("day",)).count() == 0
