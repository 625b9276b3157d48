"""Command line: ``spark-submit --py-files ... -m commentflow.jobs <job>``.

Jobs read and write folders the whole cluster can reach. ``--now`` defaults to
the time the job starts.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentflow.constants import BODY_KEYWORDS, SPLIT_RATIOS, TARGET_PRECISION, TITLE_KEYWORDS
from commentflow.operators import report
from commentflow.operators.model import Params, chunk_logits, fit_best
from commentflow.operators.pooling import score_windows
from commentflow.operators.rows import explode_pages
from commentflow.operators.state import source_state
from commentflow.operators.windows import explode_windows, weight_column, with_label_id
from commentflow.plans import flows
from commentflow.schema import CONTAINER_PAGE, SOURCE_STATE, SUBMISSION
from commentflow.session import build_session, stage
from commentflow.sources import sinks
from commentflow.sources.database import read_database
from commentflow.sources.files import read_any, read_items, read_json_lines, read_source_list
from commentflow.sources.versions import read_version, write_version


def _add_window(p: argparse.ArgumentParser) -> None:
    p.add_argument("--mode", default="days", choices=["days", "newer", "older", "range", "window"])
    for name in ("days", "from-days", "to-days"):
        p.add_argument(f"--{name}", type=int)
    for name in ("since", "until", "now"):
        p.add_argument(f"--{name}")


def _now(args) -> str:
    return getattr(args, "now", None) or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _window(args) -> flows.Window:
    return flows.Window(args.mode, _now(args), args.days, args.since, args.until, args.from_days, args.to_days)


def _land(spark: SparkSession, rows: DataFrame, args, source: str) -> None:
    """Append the new rows, then merge what was written into the state."""
    fresh = stage(rows, "fresh")
    fresh.write.mode("append").parquet(args.out)  # the flow has left out what is landed
    if args.state:
        write_version(source_state(fresh, read_version(spark, args.state), source), args.state)


def _keywords(spark: SparkSession, given: Sequence[str], file: str | None, default: Sequence[str]) -> list[str]:
    """Keywords from the command line, a file with one a line, and the default list."""
    lines = [r["source"] for r in read_source_list(spark, file).collect()] if file else []
    return list(dict.fromkeys([*given, *lines, *default]))


def extract_issues(spark: SparkSession, args) -> None:
    pages = spark.read.schema(T.StructType.fromDDL(CONTAINER_PAGE)).json(args.pages)
    rows = flows.extract_issues(
        explode_pages(pages), _window(args), sinks.landed_or_none(spark, args.out),
        read_version(spark, args.state) if args.state else None,
        read_source_list(spark, args.sources_file) if args.sources_file else None,
        _keywords(spark, args.title_keywords, args.title_keywords_file, TITLE_KEYWORDS if args.default_title_keywords else ()),
        args.include, args.reviews, args.max_per_item, args.max_per_source, args.selection,
    )
    _land(spark, rows, args, "repo")


def extract_posts(spark: SparkSession, args) -> None:
    posts = spark.read.schema(T.StructType.fromDDL(SUBMISSION)).json(args.pages)
    rows = flows.extract_posts(
        posts, _window(args), sinks.landed_or_none(spark, args.out),
        read_version(spark, args.state) if args.state else None,
        read_source_list(spark, args.sources_file) if args.sources_file else None,
        _keywords(spark, args.title_keywords, args.title_keywords_file, TITLE_KEYWORDS if args.default_title_keywords else ()),
        _keywords(spark, args.body_keywords, args.body_keywords_file, BODY_KEYWORDS if args.default_body_keywords else ()),
        args.include != "comments", args.max_per_item,
    )
    _land(spark, rows, args, "subreddit")


def backfill_posts(spark: SparkSession, args) -> None:
    """Replies of older posts, from ``start`` up to each source's low-water mark,
    which then moves down: a later run goes on from there."""
    posts = spark.read.schema(T.StructType.fromDDL(SUBMISSION)).json(args.pages)
    marks = read_version(spark, args.state)
    if marks is None:
        marks = spark.createDataFrame([], SOURCE_STATE)
    rows = flows.backfill_posts(posts, marks, args.start, sinks.landed_or_none(spark, args.out))
    stage(rows, "backfill").write.mode("append").parquet(args.out)
    done = posts.withColumn("_created", F.timestamp_seconds("created_utc")).filter(
        F.col("_created") >= F.lit(args.start).cast("timestamp")
    )
    write_version(source_state(done, marks, "subreddit", "_created"), args.state)


def ingest(spark: SparkSession, args) -> None:
    inputs = [read_any(spark, p) for p in args.inputs]
    if args.jdbc_url:
        inputs.append(read_database(spark, args.jdbc_url, args.limit, table=args.table, query=args.query))
    merged = flows.ingest(
        inputs, _now(args), args.apply_noise_filter, args.build_core_schema, args.drop_empty_text, args.source_default
    )
    sinks.write_parquet(merged, args.out)
    if args.out_meta:
        sinks.write_meta(report.ingest_meta(spark.read.parquet(args.out)), args.out_meta)


def show_report(spark: SparkSession, args) -> None:
    df = spark.read.parquet(args.input)
    report.date_range(df).show(truncate=False)
    for column in ("label", "source"):
        if column in df.columns:
            report.value_counts(df, column).orderBy(F.col("n").desc()).show(truncate=False)
    if "repo" in df.columns and args.topn > 0:
        report.top_values(df, "repo", args.topn).show(args.topn, truncate=False)


def split(spark: SparkSession, args) -> None:
    rows = flows.split_documents(spark.read.parquet(args.input), args.ratios)
    sinks.write_splits(rows, args.out)
    if args.out_meta:
        sinks.write_meta(report.split_meta(spark.read.parquet(args.out), args.ratios), args.out_meta)


def windows(spark: SparkSession, args) -> None:
    options = flows.WindowOptions(
        args.max_len, args.overlap, args.max_windows, max_input_tokens=args.filter_max_input_tokens,
        sliding=not args.truncate, domain_prefix=args.use_domain_prefix,
    )
    prepared = flows.prepare(spark.read.parquet(args.input), options)
    sinks.write_windows(prepared.windows, f"{args.out}/windows")
    sinks.write_parquet(prepared.weights, f"{args.out}/class_weights")
    parameters = {
        "max_len": args.max_len, "use_domain_prefix": args.use_domain_prefix,
        "sliding_window": not args.truncate, "slide_stride": args.overlap,
    }
    counts = prepared.expansion.select("split", "n_windows")
    meta = report.preprocess_meta(counts, spark.read.parquet(f"{args.out}/class_weights"), parameters)
    sinks.write_meta(meta, f"{args.out}/preprocess_meta")


def train(spark: SparkSession, args) -> None:
    cut = spark.read.parquet(f"{args.input}/windows")
    weights = spark.read.parquet(f"{args.input}/class_weights")
    ready = weight_column(weights, with_label_id(cut, weights.select("label", "label_id")))
    labels = {r["label"]: r["label_id"] for r in weights.select("label", "label_id").collect()}
    train_rows = stage(ready.filter(F.col("split") == "train").select("tokens", "label_id", "weight"), "train")
    dev_rows = stage(ready.filter(F.col("split") == "dev").select("tokens", "label_id"), "dev")
    grid = [Params(args.features, reg, iterations=args.iterations) for reg in args.reg]
    choice = fit_best(train_rows, dev_rows, grid, labels[args.positive])
    choice.model.write().overwrite().save(args.out)


def evaluate(spark: SparkSession, args) -> None:
    cut = spark.read.parquet(f"{args.input}/windows").filter(F.col("split") != "train")
    weights = spark.read.parquet(f"{args.input}/class_weights")
    # Scoring needs no label id, so rows of a class that training never saw count too.
    scored = chunk_logits(PipelineModel.load(args.model), cut)
    chunks = stage(scored.select("split", "id", "context_id", "label", "logits"), "chunks")
    index = weights.filter(F.col("label") == args.positive).first()["label_id"]
    result = flows.evaluate_chunks(chunks, index, args.positive, target=args.target_precision)
    sinks.write_meta(result.threshold, f"{args.out}/threshold")
    sinks.write_parquet(result.metrics, f"{args.out}/metrics")
    sinks.write_outcomes(result.outcomes, f"{args.out}/outcomes")
    sinks.write_scores(result.scores.filter(F.col("split") == "dev"), f"{args.out}/scores")


def score(spark: SparkSession, args) -> None:
    weights = spark.read.parquet(f"{args.windows}/class_weights")
    labels = [r["label"] for r in weights.select("label", "label_id").orderBy("label_id").collect()]
    threshold = read_json_lines(spark, args.threshold, "threshold double").first()["threshold"]
    items = read_items(spark, args.input)
    for missing in {"id", "context_id"} - set(items.columns):
        items = items.withColumn(missing, F.lit(None).cast("string"))
    items = items.select("id", "context_id", "text").withColumn("row", F.monotonically_increasing_id())
    cut = explode_windows(items, max_len=args.max_len, overlap=args.overlap, max_windows=None)
    chunks = chunk_logits(PipelineModel.load(args.model), cut)
    version = {"model_dir": args.model, "threshold": threshold}
    sinks.write_parquet(score_windows(chunks, labels, threshold, args.positive, version=version), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="commentflow")
    jobs = top.add_subparsers(required=True)

    def add(name: str, run) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--out")
        return p

    for name, run in (("extract-issues", extract_issues), ("extract-posts", extract_posts)):
        p = add(name, run)
        _add_window(p)
        p.add_argument("--pages", required=True, help="landed JSON lines")
        p.add_argument("--state")
        p.add_argument("--sources-file")
        p.add_argument("--title-keywords", nargs="*", default=[])
        p.add_argument("--title-keywords-file")
        p.add_argument("--default-title-keywords", action="store_true")
        if name == "extract-posts":
            p.add_argument("--body-keywords", nargs="*", default=[])
            p.add_argument("--body-keywords-file")
            p.add_argument("--default-body-keywords", action="store_true")
        p.add_argument("--include", default="comments", choices=["comments", "bodies", "both"])
        p.add_argument("--reviews", action="store_true")
        p.add_argument("--max-per-item", type=int)
        p.add_argument("--max-per-source", type=int)
        p.add_argument("--selection", default="oldest", choices=["first", "oldest", "newest", "most-reacted"])
    p = add("backfill-posts", backfill_posts)
    p.add_argument("--pages", required=True, help="landed JSON lines")
    p.add_argument("--state", required=True, help="low-water marks, read and written")
    p.add_argument("--start", required=True)
    p = add("ingest", ingest)
    p.add_argument("--inputs", nargs="*", default=[])
    p.add_argument("--jdbc-url")
    p.add_argument("--table")
    p.add_argument("--query")
    p.add_argument("--limit", type=int)
    p.add_argument("--out-meta")
    p.add_argument("--now")
    p.add_argument("--source-default")
    for flag in ("apply-noise-filter", "build-core-schema", "drop-empty-text"):
        p.add_argument(f"--{flag}", action="store_true")
    p = add("report", show_report)
    p.add_argument("--input", required=True)
    p.add_argument("--topn", type=int, default=10)
    p = add("split", split)
    p.add_argument("--input", required=True)
    p.add_argument("--ratios", nargs=3, type=float, default=list(SPLIT_RATIOS))
    p.add_argument("--out-meta")
    p = add("windows", windows)
    p.add_argument("--input", required=True)
    defaults = flows.WindowOptions()
    p.add_argument("--max-len", type=int, default=defaults.max_len)
    p.add_argument("--overlap", type=int, default=defaults.overlap)
    p.add_argument("--max-windows", type=int)
    p.add_argument("--filter-max-input-tokens", type=int)
    p.add_argument("--truncate", action="store_true", help="one window per text")
    p.add_argument("--use-domain-prefix", action="store_true")
    p = add("train", train)
    p.add_argument("--input", required=True)
    p.add_argument("--positive", default="security")
    p.add_argument("--features", type=int, default=1 << 16)
    p.add_argument("--iterations", type=int, default=30)
    p.add_argument("--reg", nargs="+", type=float, default=[0.001, 0.01, 0.1])
    p = add("evaluate", evaluate)
    p.add_argument("--input", required=True)
    p.add_argument("--model", required=True)
    p.add_argument("--positive", default="security")
    p.add_argument("--target-precision", type=float, default=TARGET_PRECISION)
    p = add("score", score)
    p.add_argument("--input", required=True, help="text with optional id and context_id")
    p.add_argument("--windows", required=True, help="output of the windows job")
    p.add_argument("--model", required=True)
    p.add_argument("--threshold", required=True)
    p.add_argument("--positive", default="security")
    p.add_argument("--max-len", type=int, default=defaults.max_len)
    p.add_argument("--overlap", type=int, default=defaults.overlap)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or build_session(), args)


if __name__ == "__main__":
    main()
