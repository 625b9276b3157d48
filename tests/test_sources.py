import pytest
from pyspark.sql import functions as F

from commentflow.constants import GITHUB_COLUMNS
from commentflow.operators import mapping
from commentflow.operators.rows import container_rows, explode_pages, forum_rows
from commentflow.schema import CONTAINER_PAGE, SUBMISSION
from commentflow.session import stage, stage_root
from commentflow.sources import database, files, sinks
from commentflow.sources.versions import read_version, write_version

HEADER = ",".join(GITHUB_COLUMNS)
ROW = 'o/r,True,7,issue_comment,c1,2024-01-01T00:00:00Z,me,"two\nlines, ""quoted""",u,o/r#pr:7,T,OPEN,cu,,,a;b\n'


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_headers(spark, tmp_path):
    for name, text, strict in (("h", HEADER + "\n" + ROW, False), ("n", ROW, False), ("s", ROW, True)):
        df = files.read_comment_csv(spark, put(tmp_path / f"{name}.csv", text), strict)
        assert df.columns == GITHUB_COLUMNS
        row = df.collect()
        assert len(row) == 1 and row[0].text == 'two\nlines, "quoted"' and row[0].container_created_at is None
    other = files.read_any(spark, put(tmp_path / "o.csv", "id,body\n1,x\n"))
    assert other.columns == ["id", "body"] and other.count() == 1
    strict = files.read_comment_csv(spark, put(tmp_path / "t.csv", "id,body\n1,x\n"), strict=True)
    assert strict.count() == 2


def test_lists_and_json(spark, tmp_path):
    names = files.read_source_list(spark, put(tmp_path / "l.txt", "a/b\n\n# no\n  c/d \n"))
    assert sorted(r.source for r in names.collect()) == ["a/b", "c/d"]
    df = spark.createDataFrame([("a/b",), ("x",)], "repo string")
    assert files.restrict_sources(df, names).collect() == [("a/b",)]
    assert files.restrict_sources(df, ["x"]).collect() == [("x",)]
    js = files.read_json_lines(spark, put(tmp_path / "j.jsonl", '{"a": 1}\n{"a": 2}\n'), "a bigint")
    assert js.agg(F.sum("a")).first()[0] == 3


def test_database_options():
    assert database.scan_options("jdbc:x", table="t") == {"url": "jdbc:x", "dbtable": "t"}
    parallel = database.scan_options("jdbc:x", query="SELECT 1 AS a", partition_column="a", lower=0, upper=9, partitions=3)
    assert parallel["dbtable"] == "(SELECT 1 AS a) q" and parallel["numPartitions"] == "3"
    for bad in ({}, {"table": "t", "partition_column": "a"}):
        with pytest.raises(ValueError):
            database.scan_options("jdbc:x", **bad)


PAGE = """{"repo": "o/r", "is_pr": %s, "nodes": [{"number": 5, "title": "T", "url": "cu", "state": "OPEN",
 "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-03T00:00:00Z", "author": null,
 "labels": {"nodes": [{"name": "a"}, {"name": "b"}]}, "bodyText": null,
 "comments": {"nodes": [{"id": "C1", "url": "u1", "bodyText": "hi", "createdAt": "2024-01-02T00:00:00Z",
   "author": {"login": "me"}, "reactionGroups": [{"content": "X", "users": {"totalCount": 2}}, {"content": "Y", "users": null}]}]},
 "reviewThreads": {"nodes": [
   {"id": "T1", "comments": {"nodes": [{"id": "R1", "createdAt": "2024-01-02T00:00:00Z"}, {"id": "R2"}]}},
   {"id": "T2", "comments": {"nodes": [{"id": "R3"}]}}]}}, {"number": 6}]}"""


def pages(spark, is_pr):
    text = (PAGE % str(is_pr).lower()).replace("\n", " ")
    return spark.createDataFrame([(text,)], "v string").select(F.from_json("v", CONTAINER_PAGE).alias("p")).select("p.*")


def test_container_rows(spark):
    issue = {r.comment_id: r for r in container_rows(explode_pages(pages(spark, False))).collect()}
    assert set(issue) == {"github_issuebody_o/r#5", "github_issuebody_o/r#6", "github_issuecomment_C1"}
    body = issue["github_issuebody_o/r#5"]
    assert (body.text, body.comment_author, body.container_labels, body.context_id) == ("", None, "a;b", "o/r#issue:5")
    comment = issue["github_issuecomment_C1"]
    assert (comment.reactions, comment.comment_author, comment.container_title) == (2, "me", "T")
    assert issue["github_issuebody_o/r#6"].container_labels == ""
    pr = {r.comment_id: r for r in container_rows(explode_pages(pages(spark, True))).collect()}
    assert set(pr) == {
        "github_prbody_o/r#5", "github_prbody_o/r#6", "github_pr_issuecomment_C1",
        *(f"github_pr_reviewcomment_R{i}" for i in (1, 2, 3)),
    }
    review = pr["github_pr_reviewcomment_R3"]
    assert (review.thread_id, review.container_title, review.context_id) == ("T2", None, "o/r#pr:5")
    assert container_rows(explode_pages(pages(spark, True)), comments=False, reviews=False).count() == 2


def test_forum_rows(spark):
    rows = ['{"subreddit": "s", "id": "p", "title": "T", "selftext": " ", "permalink": "/p", "created_utc": 0.5, "comments": '
            '[{"id": "c", "body": null, "created_utc": null, "score": 3, "parent_id": "t3_p"}]}',
            '{"subreddit": "s", "id": "q", "selftext": "x", "permalink": "/q", "created_utc": 60}']
    posts = spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", SUBMISSION).alias("p")).select("p.*")
    got = {r.comment_id: r for r in forum_rows(posts).collect()}
    assert set(got) == {"c", "reddit_postbody_q"}
    assert got["c"].comment_created_utc == "1970-01-01T00:00:00Z" and got["c"].comment_body == ""
    assert got["c"].comment_permalink == "https://www.reddit.com/p"


def test_core_mapping(spark):
    now = "2024-02-01 00:00:00"
    reddit = spark.createDataFrame([("s", "p1", "c1", "2024-01-01T00:00:00Z", "hello")],
                                   "subreddit string, submission_id string, comment_id string, comment_created_utc string, comment_body string")
    row = mapping.normalize(mapping.to_core(reddit, now), now).first()
    assert (row.id, row.text, row.source, row.context_id, row.label) == ("c1", "hello", "reddit", "reddit#post:p1", "other")
    bare = spark.createDataFrame([("x",), ("x",), (None,)], "body string")
    got = mapping.normalize(mapping.to_core(bare, now), now).collect()
    assert len({r.id for r in got}) == 2 and all(r.created_at_imputed is False for r in got)
    assert got[0].source == "unknown" and got[0].context_id == got[0].id
    numeric = spark.createDataFrame([(1, 1704067200.0), (2, 1e18)], "name int, created_utc double").withColumn("content", F.lit("t"))
    times = {r.id: r for r in mapping.normalize(mapping.to_core(numeric, now), now).collect()}
    assert str(times["1"].created_at) == "2024-01-01 00:00:00" and times["2"].created_at_imputed
    with pytest.raises(ValueError):
        mapping.to_core(spark.range(1), now)
    with pytest.raises(ValueError):
        mapping.union_inputs([])
    flags = spark.createDataFrame([("TRUE",), ("false",), ("nan",), (None,)], "b string")
    assert [r[0] for r in flags.select(mapping.parse_bool(F.col("b"))).collect()] == [True, False, None, None]


def test_append_twice_is_append_once(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "id string, text string")
    for _ in range(2):
        sinks.append_unseen(first, out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    sinks.append_unseen(spark.createDataFrame([("b", "x"), ("c", "y")], "id string, text string"), out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_staging(spark):
    df = stage(spark.range(5), "t")
    assert df.count() == 5
    path = df.inputFiles()[0]
    assert stage_root(spark) in path
    assert stage_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", 2), ("dev", 1), ("train", 1)], "split string, n int").withColumn(
        "created_at", F.timestamp_seconds("n")
    )
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    assert (tmp_path / "s" / "split=train").is_dir()
    sinks.write_meta(spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().m.a == 1
    labelled = spark.createDataFrame([("x", ["a", "b"], 'q"\n')], "id string, labels array<string>, text string")
    sinks.write_comment_csv(labelled, str(tmp_path / "c"), ["id", "labels", "text"])
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.first()[:] == ("x", "a;b", 'q"\n')
    scores = spark.createDataFrame([(0.5, 1)], "score double, y int")
    sinks.write_scores(scores, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()[:] == (0.5, 1)


def test_header_is_decided_per_file(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    put(folder / "a.csv", ROW + ROW.replace("c1", "c2"))
    put(folder / "b.csv", HEADER + "\n" + ROW.replace("c1", "c3") + ROW.replace("c1", "c4"))
    put(folder / "c.csv", ROW.replace("c1", "c5") + ROW.replace("c1", "c6"))
    got = files.read_comment_csv(spark, str(folder))
    assert got.columns == GITHUB_COLUMNS
    assert sorted(r.comment_id for r in got.collect()) == ["c1", "c2", "c3", "c4", "c5", "c6"]


def test_rows_without_id_append_once(spark, tmp_path):
    data = [(None, "one"), (None, "two"), ("a", "three"), (None, "one")]
    df = spark.createDataFrame(data, "id string, text string")
    for _ in range(3):
        sinks.append_unseen(df, str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    assert sorted(r.text for r in landed.collect()) == ["one", "three", "two"]
    assert landed.filter("id IS NULL").count() == 0


def test_staged_tables_are_released(spark, tmp_path, monkeypatch):
    import os

    from commentflow import session

    monkeypatch.setattr(session, "stage_root", lambda _: str(tmp_path / "own"))
    stage(spark.range(3), "x")
    folder = os.path.dirname(session.stage_path(spark, "y"))
    assert os.listdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)


def test_items_of_any_shape(spark, tmp_path):
    lines = '{"id": 7, "context_id": "c", "text": "one"}\n"two \\"quoted\\""\nthree, bare\n\n{"text": null}\n'
    got = files.read_items(spark, put(tmp_path / "items.jsonl", lines)).collect()
    assert [(r.id, r.context_id, r.text) for r in got] == [
        ("7", "c", "one"), (None, None, 'two "quoted"'), (None, None, "three, bare"), (None, None, None)]


def test_keywords_from_file_and_defaults(spark, tmp_path):
    from commentflow import jobs

    path = put(tmp_path / "k.txt", "# mine\nleak\n\ncrash\n")
    assert jobs._keywords(spark, ["boom"], path, ["leak", "oom"]) == ["boom", "leak", "crash", "oom"]
    args = jobs.parser().parse_args(["extract-posts", "--pages", "x", "--body-keywords-file", "k", "--default-body-keywords"])
    assert args.body_keywords_file == "k" and args.default_body_keywords


def test_backfill_job_resumes(spark, tmp_path):
    import json

    from commentflow import jobs

    def post(i, day, comment):
        return {"subreddit": "s", "id": f"p{i}", "title": "t", "selftext": "b", "author": "a", "permalink": "/p", "created_utc": 86400.0 * day,
                "comments": [{"id": comment, "parent_id": f"t3_p{i}", "body": "text", "author": "a", "permalink": "/c", "score": 1, "created_utc": 86400.0 * day}]}

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for start, posts in (("1970-02-01 00:00:00", [post(1, 60, "c1"), post(2, 50, "c2"), post(3, 10, "c3")]), ("1970-01-01 00:00:00", [post(1, 60, "c9"), post(3, 10, "c3")])):
        pages = put(tmp_path / "pages.jsonl", "\n".join(map(json.dumps, posts)))
        jobs.main(["backfill-posts", "--pages", pages, "--out", out, "--state", state, "--start", start], spark)
    assert sorted(r.comment_id[-2:] for r in spark.read.parquet(out).collect()) == ["c1", "c2", "c3"]
    mark = read_version(spark, state).first()
    assert (mark.oldest_ts.month, mark.oldest_ts.day) == (1, 11)


def test_versions(spark, tmp_path):
    """The newest version wins; one that was begun and not finished does not count."""
    path = str(tmp_path / "state")
    assert read_version(spark, path) is None
    for n in range(3):
        rows = spark.createDataFrame([("a", n)], "source string, n int")
        before = read_version(spark, path)
        assert write_version(rows if before is None else before.withColumn("n", before["n"] + 1), path) == n
    assert read_version(spark, path).collect() == [("a", 2)] and read_version(spark, path, 1).collect() == [("a", 1)]
    (tmp_path / "state" / "version=3" / "_temporary").mkdir(parents=True)
    assert read_version(spark, path).collect() == [("a", 2)]
    assert write_version(rows.limit(0), path) == 3 and read_version(spark, path).collect() == [("a", 2)]
