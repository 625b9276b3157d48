"""One query per operator, over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentflow.constants import GITHUB_COLUMNS, TITLE_KEYWORDS
from commentflow.functions import labels as lb
from commentflow.functions import scores as sc
from commentflow.functions import text as tx
from commentflow.functions import timecols as tc
from commentflow.functions import tokens as tk
from commentflow.operators import (
    calibrate,
    evaluate,
    exact_fit,
    filters,
    mapping,
    ordered,
    payload,
    pooling,
    report,
    rows,
    select,
    split,
    state,
    windows,
)
from commentflow.plans import flows
from commentflow.plans.tables import (
    NOW,
    as_comments,
    chunks,
    comments,
    documents,
    landed,
    micros,
    read,
    scores,
)
from commentflow.schema import CONTAINER_PAGE
from commentflow.session import configure, stage, stage_path
from commentflow.sources import landed as landed_ids
from commentflow.sources import sinks
from commentflow.sources.files import read_comment_csv, read_items, read_json_lines, read_parquet, restrict_sources
from commentflow.sources.landed import LandedIndex
from commentflow.streaming import ingest as streaming
from commentflow.streaming.ledger import Ledger, LedgerSelection

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

WINDOW = dict(max_len=66, overlap=16, special=2)
THRESHOLD = 0.5
CLASSES = ["bug", "other", "security"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r6(col: Column) -> Column:
    return F.round(col, 6)


def _big(col: Column) -> Column:
    return col.cast("bigint")


# ---- scans and sources -----------------------------------------------------

@query
def scan_project(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "source"])


@query
def source_allowlist(spark, sf_dir):
    names = read(spark, sf_dir, "region").select(
        F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("source")
    )
    return restrict_sources(comments(spark, sf_dir), names).select("id", "repo")


def _pages(spark, sf_dir) -> DataFrame:
    """A page of payload text per document: one pull request whose review
    threads are the document's lines."""
    lines = F.split("text", "\n")
    number = F.col("doc_id")
    created = F.lit("2024-01-01T00:00:00Z")

    def thread(line: Column, i: Column) -> Column:
        comment = F.struct(
            F.concat_ws("-", number.cast("string"), i.cast("string")).alias("id"),
            line.alias("bodyText"),
            created.alias("createdAt"),
            F.struct(F.col("lang").alias("login")).alias("author"),
        )
        return F.struct(
            F.concat(F.lit("t"), i.cast("string")).alias("id"),
            F.struct(F.array(comment).alias("nodes")).alias("comments"),
        )

    node = F.struct(
        number.alias("number"),
        F.col("text").alias("bodyText"),
        created.alias("createdAt"),
        F.struct(F.transform(lines, thread).alias("nodes")).alias("reviewThreads"),
    )
    page = F.struct(
        F.col("source").alias("repo"), F.lit(True).alias("is_pr"), F.array(node).alias("nodes")
    )
    return read(spark, sf_dir, "documents").select(F.to_json(page).alias("payload"))


@query
def flatten_nested(spark, sf_dir):
    parsed = _pages(spark, sf_dir).select(F.from_json("payload", CONTAINER_PAGE).alias("p")).select("p.*")
    flat = rows.container_rows(rows.explode_pages(parsed), comments=False)
    return flat.select("comment_id", "context_id", "comment_type", "comment_author", "text", "thread_id")


@query
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k int")
    return read(spark, sf_dir, "events").select("event_id", _big(parsed["k"]).alias("k"))


@query
def container_join(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return rows.join_containers(items, orders, "l_orderkey", "o_orderkey").select(
        "l_orderkey",
        _big(F.col("l_linenumber")).alias("l_linenumber"),
        "l_partkey",
        "o_orderstatus",
        micros(F.col("o_orderdate")).alias("updated_us"),
    )


@query
def union_inputs(spark, sf_dir):
    first = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    second = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    both = mapping.union_inputs([first, second])
    return both.withColumn("src_ord", _big(F.col("src_ord")))


@query
def append_unseen(spark, sf_dir):
    fresh = state.unseen(state.dedupe(comments(spark, sf_dir)), landed(spark, sf_dir))
    return fresh.select("id", "repo", micros(F.col("created_at")).alias("created_us"))


@query
def dedupe_keep_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return state.keep_first(docs, ["key"], [F.col("doc_id").asc()])


# ---- mapping ----------------------------------------------------------------

@query
def map_core_schema(spark, sf_dir):
    link = (
        F.when(F.col("event_type") == "signup", "https://github.com/o/r/issues/1")
        .when(F.col("event_type") == "click", "https://www.reddit.com/r/x/1")
        .otherwise("")
    )
    raw = comments(spark, sf_dir).select(
        "repo",
        "issue_number",
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("comment_id"),
        F.concat(F.lit(" "), "event_type", F.lit("\t\u200b"), "context_id").alias("body"),
        link.alias("comment_url"),
        F.when(F.col("event_type") != "error", tc.iso(F.col("created_at"))).otherwise("n/a").alias("comment_created_at"),
    )
    core = mapping.normalize(mapping.to_core(raw, NOW), NOW)
    return core.select(
        "id", "text", "label", "source", micros(F.col("created_at")).alias("created_us"),
        "context_id", _big(F.col("created_at_imputed").cast("int")).alias("imputed"),
    )


PAYLOAD = (payload.Field("k", "$.k", "bigint", True), payload.Field("tag", "$.tag"))


def _drifting(spark, sf_dir) -> DataFrame:
    """Events whose payload changes its shape: as it is, retyped, cut off, with one more
    field, nested, null."""
    k, shape = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    text = (
        F.when(shape == 0, F.concat(F.lit('{"k": "'), k, F.lit('"}')))
        .when(shape == 1, F.col("props").substr(F.lit(1), F.length("props") - 1))
        .when(shape == 2, F.concat(F.lit('{"tag": "t'), k, F.lit('", "k": '), k, F.lit("}")))
        .when(shape == 3, F.concat(F.lit('{"reactions": {"k": '), k, F.lit('}, "tag": ['), k, F.lit("]}")))
        .when(shape == 4, F.when(F.col("event_id") % 2 == 0, '{"k": null, "tag": null}'))
        .otherwise(F.col("props"))
    )
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", text.alias("payload"))


@query
def payload_check(spark, sf_dir):
    """Typed values of the payloads that fit, and what is wrong with the others."""
    good, rejected = payload.split_payloads(_drifting(spark, sf_dir), "payload", PAYLOAD)
    faults = F.array_join(F.transform("problems", lambda p: F.concat_ws(":", p["field"], p["problem"], p["found"])), ",")
    return good.select("id", "k", "tag", F.lit("").alias("problems")).unionByName(
        rejected.select("id", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("string").alias("tag"), faults.alias("problems"))
    )


@query
def payload_shapes(spark, sf_dir):
    """How often each path held a value of which type, per event type."""
    return payload.shapes(_drifting(spark, sf_dir), "payload", ("$.k", "$.tag", "$.reactions"), ("event_type",))


@query
def row_builders(spark, sf_dir):
    """Each event as a landed container with a comment and, for pull requests,
    a review comment."""
    created = tc.iso(F.col("created_at"))
    author = F.struct(F.when(F.col("event_type") != "error", F.col("repo")).alias("login"))
    groups = F.array(
        F.struct(F.lit("UP").alias("content"), F.struct(F.col("reactions").alias("totalCount")).alias("users")),
        F.struct(F.lit("EYES").alias("content"),
                 F.struct(F.lit(None).cast("bigint").alias("totalCount")).alias("users")),
    )

    def comment(prefix: str) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"),
            F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("url"),
            F.when(F.col("event_type") != "view", F.col("event_type")).alias("bodyText"),
            created.alias("createdAt"),
            author.alias("author"),
            groups.alias("reactionGroups"),
        )

    thread = F.struct(
        F.concat(F.lit("th"), F.col("issue_number").cast("string")).alias("id"),
        F.struct(F.array(comment("r")).alias("nodes")).alias("comments"),
    )
    containers = comments(spark, sf_dir).select(
        "repo",
        "is_pr",
        F.col("id").alias("number"),
        F.concat(F.lit("Item "), F.col("issue_number").cast("string")).alias("title"),
        F.lit("https://h/c").alias("url"),
        F.lit("OPEN").alias("state"),
        created.alias("createdAt"),
        created.alias("updatedAt"),
        author.alias("author"),
        F.struct(
            F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.col("repo").alias("name"))).alias("nodes")
        ).alias("labels"),
        F.col("event_type").alias("bodyText"),
        F.struct(F.array(comment("c")).alias("nodes")).alias("comments"),
        F.struct(F.array(thread).alias("nodes")).alias("reviewThreads"),
    )
    return rows.container_rows(containers).select(
        "repo", "issue_number", "comment_type", "comment_id", "comment_created_at", "comment_author",
        "text", "comment_url", "context_id", "container_title", "container_labels", "thread_id", "reactions",
    )


@query
def forum_row_builders(spark, sf_dir):
    """Each event as a landed forum post with one comment."""
    e = comments(spark, sf_dir)
    post_id = F.concat(F.lit("p"), F.col("id").cast("string"))
    seconds = tc.epoch(F.col("created_at")).cast("double")
    reply = F.struct(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("t3_"), post_id).alias("parent_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("body"),
        F.lit(None).cast("string").alias("author"),
        F.lit("/r/x/c").alias("permalink"),
        F.col("reactions").alias("score"),
        F.when(F.col("event_type") != "click", seconds + 60).alias("created_utc"),
    )
    posts = e.select(
        F.col("repo").alias("subreddit"),
        post_id.alias("id"),
        F.col("event_type").alias("title"),
        F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("context_id")).alias("selftext"),
        F.col("repo").alias("author"),
        F.lit("/r/x").alias("permalink"),
        seconds.alias("created_utc"),
        F.array(reply).alias("comments"),
    )
    return rows.forum_rows(posts).select(
        "subreddit", "submission_id", "submission_created_utc", "comment_id", "comment_created_utc",
        "comment_author", "comment_body", "comment_permalink", "submission_url",
    )


@query
def infer_source(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select(
        "page_id", mapping.infer_source(pages, "example.com", "example.net").alias("source")
    )


def _docs_with_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query
def null_fill(spark, sf_dir):
    filled = mapping.fill_text(_docs_with_quality(spark, sf_dir), ["quality", "container_title"])
    return filled.select("doc_id", "quality", "container_title")


@query
def bool_normalize(spark, sf_dir):
    words = F.when(F.col("quality") == 1, "True").when(F.col("quality") == 0, "FALSE").otherwise("n/a")
    return _docs_with_quality(spark, sf_dir).select(
        "doc_id", mapping.parse_bool(words).cast("string").alias("flag")
    )


def _time_texts(spark, sf_dir) -> DataFrame:
    """Times as text: ISO, epoch digits, junk or nothing, by event type."""
    kind, ts = F.col("event_type"), F.col("created_at")
    text = (
        F.when(kind == "click", tc.epoch(ts).cast("string"))
        .when(kind == "error", "n/a")
        .when(kind == "purchase", F.lit(None))
        .otherwise(tc.iso(ts))
    )
    return comments(spark, sf_dir).select(
        "id",
        text.alias("time_text"),
        F.when(kind != "error", F.date_format(ts, "yyyy-MM-dd")).alias("day_text"),
    )


@query
def ts_coalesce(spark, sf_dir):
    first = F.when(~F.col("time_text").rlike("^[0-9]+$"), F.col("time_text"))
    return _time_texts(spark, sf_dir).select(
        "id", micros(tc.ts_coalesce(first, F.col("day_text"))).alias("ts_us")
    )


@query
def ts_epoch_or_iso(spark, sf_dir):
    parsed = F.coalesce(tc.epoch_or_iso(F.col("time_text")), tc.instant(NOW))
    return _time_texts(spark, sf_dir).select("id", micros(parsed).alias("ts_us"))


@query
def iso_epoch(spark, sf_dir):
    ts = F.col("created_at")
    text = tc.iso(ts)
    return comments(spark, sf_dir).select(
        "id", text.alias("iso"), tc.epoch(ts).alias("epoch"), tc.epoch(tc.parse_ts(text)).alias("back")
    )


# ---- text and labels --------------------------------------------------------

@query
def light_norm(spark, sf_dir):
    """Whole texts with tabs, returns, blanks and zero-width marks worked in."""
    noisy = F.concat(
        F.lit("\u00a0\t"),
        F.replace(F.replace("text", F.lit(". "), F.lit(".\t  ")), F.lit("\n"), F.lit("\r\n\n")),
        F.lit("\u200b \f\u3000"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", tx.light_norm(noisy).alias("text"))


@query
def build_context(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "id", lb.build_context(F.col("title"), F.col("labels")).alias("context")
    )


@query
def label_list(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("lang"), F.lit(" ;;"), F.col("source"))
    return documents(spark, sf_dir).select("id", lb.join_labels(lb.label_list(raw)).alias("labels"))


@query
def domain_prefix(spark, sf_dir):
    source = (
        F.when(F.col("source") == "src0", "<GITHUB>")
        .when(F.col("source") == "src1", "www.Reddit.com")
        .otherwise(F.col("source"))
    )
    docs = documents(spark, sf_dir).select("id", "text", source.alias("source"))
    return windows.with_domain_prefix(docs).select("id", "text")


def _weak() -> Column:
    return lb.weak_label(
        F.col("text"), F.col("title"), F.col("labels"),
        security_labels=["src3"], bug_labels=["de"],
        security_keywords=["license", "@"], bug_title_keywords=["token"],
    )


@query
def weak_label(spark, sf_dir):
    return documents(spark, sf_dir).select("id", _weak().alias("label"))


@query
def label_dist(spark, sf_dir):
    return report.value_counts(documents(spark, sf_dir).select(_weak().alias("label")), "label")


@query
def source_dist(spark, sf_dir):
    return report.value_counts(documents(spark, sf_dir), "source")


@query
def keyword_filter(spark, sf_dir):
    """The default title keywords against whole texts."""
    return filters.keep_keywords(documents(spark, sf_dir), {"text": TITLE_KEYWORDS}).select("id")


@query
def keyword_title_and_body(spark, sf_dir):
    words = {"title": ["The ", "de", ""], "text": [" License", "@", "TOKEN"]}
    return filters.keep_keywords(documents(spark, sf_dir), words).select("id")


@query
def noise_filter(spark, sf_dir):
    author = F.when(F.col("source") == "src2", F.concat("lang", F.lit("-Bot"))).otherwise(F.col("source"))
    docs = documents(spark, sf_dir).withColumn("comment_author", author)
    return filters.drop_noise(docs, templates=["Released under the MIT License"]).select("id")


@query
def drop_empty_text(spark, sf_dir):
    text = F.when(F.col("turn") == 0, F.lit(" \n\t\u00a0")).when(F.col("turn") == 1, F.lit(None)).otherwise(F.col("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return filters.drop_empty_text(turns)


# ---- windows in time and selection ----------------------------------------

def _state(spark, sf_dir) -> DataFrame:
    return state.source_state(landed(spark, sf_dir))


@query
def window_bounds(spark, sf_dir):
    now, since = (F.lit(t).cast("timestamp_ntz") for t in (NOW, "2024-03-01 00:00:00"))
    common = dict(now=now, newest=F.col("newest_ts"), oldest=F.col("oldest_ts"))
    cases = {
        "days": dict(days=0),
        "newer": dict(days=0),
        "older": dict(days=30),
        "range": dict(from_days=30, to_days=7),
        "window": dict(since=since),
    }
    bounds = []
    for mode, extra in cases.items():
        low, high = tc.window_bounds(mode, **common, **extra)
        bounds.append(F.struct(F.lit(mode).alias("mode"), micros(low).alias("low_us"), micros(high).alias("high_us")))
    return _state(spark, sf_dir).select("source", F.inline(F.array(*bounds)))


@query
def window_filter(spark, sf_dir):
    kept = filters.in_window(comments(spark, sf_dir), "newer", NOW, state=_state(spark, sf_dir))
    return kept.select("id", "repo")


@query
def window_filter_days(spark, sf_dir):
    return filters.in_window(comments(spark, sf_dir), "days", NOW, days=12).select("id", "repo")


@query
def cutoff_filter(spark, sf_dir):
    return filters.since(comments(spark, sf_dir), "created_at", "2024-01-20 00:00:00").select("id", "repo")


@query
def backfill_filter(spark, sf_dir):
    marks = state.source_state(filters.since(comments(spark, sf_dir), "created_at", "2024-01-11 00:00:00"))
    kept = filters.backfill(comments(spark, sf_dir), marks, "2024-01-05 00:00:00", "repo", "created_at")
    return kept.select("id", "repo")


@query
def freshness_prune(spark, sf_dir):
    return filters.since(read(spark, sf_dir, "orders"), "o_orderdate", "1998-01-01 00:00:00").select(
        "o_orderkey", "o_custkey"
    )


@query
def freshness_prune_state(spark, sf_dir):
    """Containers that changed since the newest landed comment of their source."""
    changed = comments(spark, sf_dir).groupBy("context_id", "repo").agg(F.max("created_at").alias("updated_at"))
    return filters.fresh(changed, "newer", NOW, _state(spark, sf_dir)).select("context_id", "repo")


def _forum(spark, sf_dir) -> DataFrame:
    """Comments with a parent and a body; errors are removed, clicks are replies."""
    kind = F.col("event_type")
    return comments(spark, sf_dir).withColumns({
        "parent_id": F.concat(F.when(kind == "click", "t1_").otherwise("t3_"), "context_id"),
        "text": F.when(kind == "error", "[removed]").when(kind == "signup", " [deleted]\n").otherwise(kind),
    })


@query
def top_level_filter(spark, sf_dir):
    return _forum(spark, sf_dir).filter(filters.top_level(F.col("parent_id"))).select("id")


@query
def removed_filter(spark, sf_dir):
    return _forum(spark, sf_dir).filter(~filters.removed(F.col("text"))).select("id")


@query
def body_policy(spark, sf_dir):
    return filters.body_policy(_forum(spark, sf_dir), "bodies").select("id", "comment_type")


@query
def thread_order(spark, sf_dir):
    # Ranked rows are staged, so only what the result needs goes in.
    narrow = comments(spark, sf_dir).select("id", "repo", "issue_number", "comment_type", "created_at")
    return select.thread_order(narrow).select("id", "repo", "issue_number", "position")


def _top2(policy: str) -> Query:
    def run(spark, sf_dir):
        return select.select_per_item(comments(spark, sf_dir), 2, policy).select("id", "context_id")

    run.__name__ = "topk_" + policy.replace("-", "_")
    return run


for _policy in ("oldest", "newest", "most-reacted"):
    query(_top2(_policy))


@query
def topk_score(spark, sf_dir):
    recent = filters.in_window(_forum(spark, sf_dir), "days", NOW, days=20)
    fresh = state.unseen(recent, landed(spark, sf_dir))
    return select.select_by_score(fresh, 2).select("id", "context_id")


@query
def source_budget(spark, sf_dir):
    rows_ = comments(spark, sf_dir)
    updated = rows_.groupBy("context_id").agg(F.max("created_at").alias("container_updated_at"))
    fresh = state.unseen(rows_, landed(spark, sf_dir)).join(updated, "context_id")
    return select.source_budget(fresh, 50).select("id", "repo", "comment_type")


@query
def source_budget_large(spark, sf_dir):
    """A budget beyond the group limit: ranks inside sources of any size."""
    rows_ = comments(spark, sf_dir).drop("event_type", "reactions", "score")
    updated = rows_.groupBy("context_id").agg(F.max("created_at").alias("container_updated_at"))
    return select.source_budget(rows_.join(updated, "context_id"), 1200).select("id", "repo", "comment_type")


@query
def limit_rows(spark, sf_dir):
    return documents(spark, sf_dir).select("id", "lang").orderBy("id").limit(100)


@query
def reaction_sum(spark, sf_dir):
    def group(n: Column) -> Column:
        return F.struct(F.struct(n.alias("totalCount")).alias("users"))

    none = F.when(F.col("event_type") == "view", F.lit(None).cast("bigint")).otherwise(F.col("issue_number"))
    groups = F.when(
        F.col("event_type") != "error", F.array(group(F.col("reactions")), group(none))
    )
    return comments(spark, sf_dir).select("id", sc.reaction_sum(groups).alias("reactions"))


@query
def source_state(spark, sf_dir):
    merged = state.source_state(
        filters.since(comments(spark, sf_dir), "created_at", "2024-01-08 00:00:00"), _state(spark, sf_dir)
    )
    return merged.select(
        "source", micros(F.col("newest_ts")).alias("newest_us"), micros(F.col("oldest_ts")).alias("oldest_us")
    )


# ---- order, split, reports --------------------------------------------------

@query
def global_rank(spark, sf_dir):
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_ts"))
    ranked = ordered.global_rank(first, [F.col("first_ts").asc(), F.col("o_custkey").asc()])
    return ranked.select("o_custkey", "rank")


def _split_orders(spark, sf_dir) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return split.thread_split(orders, thread="o_custkey", created="o_orderdate")


@query
def thread_split(spark, sf_dir):
    return _split_orders(spark, sf_dir).select("o_orderkey", "split")


@query
def split_counts(spark, sf_dir):
    return split.split_counts(_split_orders(spark, sf_dir))


@query
def heavy_sources(spark, sf_dir):
    """The twenty parts with most lines, by a bounded sketch: how many are listed, whether
    every count is within the bound, and whether no larger one is missing."""
    lines = read(spark, sf_dir, "lineitem").select(_big(F.col("l_partkey")).alias("part"))
    listed = stage(report.heavy_hitters(lines, "part", 20, tracked=4096), "heavy")
    exact = report.value_counts(lines, "part", "true_n")
    both = exact.join(listed, "part", "left")
    low = listed.agg(F.min(F.col("n") - F.col("error"))).scalar()
    return both.agg(
        F.count("n").alias("n_listed"),
        F.bool_and(F.col("n").isNull() | (F.abs(F.col("n") - F.col("true_n")) <= F.col("error"))).alias("within"),
        F.bool_and(F.col("n").isNotNull() | (F.col("true_n") <= low + 2 * F.coalesce(F.lit(listed.agg(F.max("error")).first()[0]), F.lit(0)))).alias("complete"),
    )


@query
def clustered_layout(spark, sf_dir):
    """Comments written clustered by source and time, then two weeks of three sources read."""
    path = stage_path(spark, "clustered")
    sinks.write_clustered(comments(spark, sf_dir), path, row_group=1 << 20)
    week = spark.read.parquet(path).filter(F.col("repo").isin("src1", "src4", "src9"))
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-08 00:00:00", "2024-01-22 00:00:00"))
    found = week.filter((F.col("created_at") >= low) & (F.col("created_at") < high))
    return found.select("id", "repo", micros(F.col("created_at")).alias("created_us"))


@query
def score_items(spark, sf_dir):
    """Items of mixed shape written as lines (records, quoted and bare text), read and coerced."""
    path = stage_path(spark, "items")
    one_line = F.regexp_replace("text", r"\s+", " ")
    plain = F.concat(F.lit("x "), F.translate(one_line, '"\\', ""))
    shape = F.col("id") % 3
    line = (
        F.when(shape == 0, F.to_json(F.struct(F.col("id").cast("string").alias("id"), "context_id", one_line.alias("text"))))
        .when(shape == 1, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(plain)
    )
    documents(spark, sf_dir).select(line.alias("value")).write.text(path)
    return read_items(spark, path).select("id", "context_id", F.md5("text").alias("key"))


@query
def ingest_meta(spark, sf_dir):
    meta = report.ingest_meta(documents(spark, sf_dir).withColumn("label", _weak()))

    def entries(section: str, counts: Column) -> Column:
        return F.transform(
            F.map_entries(counts),
            lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("key"), e["value"].alias("n")),
        )

    def single(key: str, n: Column) -> Column:
        return F.struct(F.lit("total").alias("section"), F.lit(key).alias("key"), n.alias("n"))

    totals = F.array(
        single("rows", F.col("rows")),
        single("columns", _big(F.size("columns_present"))),
        single("first_us", micros(F.col("created_at_range")[0])),
        single("last_us", micros(F.col("created_at_range")[1])),
    )
    return meta.select(
        F.inline(F.concat(totals, entries("label", F.col("label_dist")), entries("source", F.col("source_dist"))))
    )


@query
def date_range(spark, sf_dir):
    return report.date_range(comments(spark, sf_dir)).select(
        "n_rows", micros(F.col("first_ts")).alias("first_us"), micros(F.col("last_ts")).alias("last_us")
    )


@query
def top_sources(spark, sf_dir):
    return report.top_values(comments(spark, sf_dir), "repo", 5)


# ---- tokens -----------------------------------------------------------------

def _count() -> Column:
    return F.size(tk.tokenize(F.col("text")))


@query
def token_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("id", _big(_count()).alias("n_tokens"))


@query
def token_len_filter(spark, sf_dir):
    return windows.drop_long(documents(spark, sf_dir), 500).select("id")


@query
def token_truncate(spark, sf_dir):
    cut = windows.explode_windows(
        documents(spark, sf_dir).select("id", "text"), sliding=False, max_len=66, overlap=16
    )
    return cut.select("id", windows.window_text(F.col("tokens")).alias("tokens"))


@query
def token_windows(spark, sf_dir):
    cut = windows.explode_windows(documents(spark, sf_dir).select("id", "context_id", "text"), max_windows=8, **WINDOW)
    return cut.select(
        "id", "context_id", _big(F.col("window_no")).alias("window_no"),
        windows.window_text(F.col("tokens")).alias("tokens"),
        _big(F.size("attention_mask")).alias("n_tokens"),
    )


@query
def length_profile(spark, sf_dir):
    out = report.length_profile(documents(spark, sf_dir), tk.token_length(tk.tokenize(F.col("text"))))
    exact = ("n_rows", "min", "max")
    return out.select(*[F.col(c) if c in exact else _r6(F.col(c)).alias(c) for c in out.columns])


@query
def length_sketch(spark, sf_dir):
    """Profiles merged from one sketch per language and source, stored first: what is exact,
    and per percentile whether the rank it stands for is within the bound."""
    docs = documents(spark, sf_dir).select("lang", "source", _big(_count()).alias("v"))
    sketches = stage(report.length_sketches(docs, F.col("v"), ("lang", "source")), "sketches")
    merged = report.merged_profile(sketches, ("lang",))
    ranks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = merged.select(
        "lang", "n_rows", "mean", "min", "max",
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"), F.col(n).alias("q")) for n, p in ranks.items()])),
    )
    counts = docs.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("n"))
    q = F.col("q")
    seen = found.join(counts, "lang").groupBy("lang", "n_rows", "mean", "min", "max", "name", "p").agg(
        F.coalesce(F.sum(F.when(F.col("v") < q, F.col("n"))), F.lit(0)).alias("below"),
        F.sum(F.when(F.col("v") <= q, F.col("n"))).alias("upto"),
    )
    slack = F.lit(2 * report.SKETCH_ERROR) * F.col("n_rows") + 1
    within = (F.col("below") <= F.col("p") * F.col("n_rows") + slack) & (F.col("upto") >= F.col("p") * F.col("n_rows") - slack)
    return seen.select("lang", "name", "n_rows", _r6(F.col("mean")).alias("mean"), "min", "max", within.alias("within"))


@query
def expansion_factor(spark, sf_dir):
    out = report.expansion_factor(documents(spark, sf_dir), tk.window_count(_count(), **WINDOW), by="lang")
    return out.withColumn("factor", _r6(F.col("factor")))


def _labelled(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("quality") == 1, "security").when(F.col("toxic") == 1, "bug").otherwise("other")
    quality = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), name.alias("label"))
    return documents(spark, sf_dir).select("id", "text", "lang").join(quality, "id")


def _weights(spark, sf_dir) -> DataFrame:
    return windows.class_weights(_labelled(spark, sf_dir), count=tk.window_count(_count(), **WINDOW))


@query
def class_weights(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("weight", _r6(F.col("weight")))


@query
def label_dictionary(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id", F.col("lang").alias("label"))
    return windows.with_label_id(docs, windows.label_dictionary(docs)).select("id", "label", "label_id")


@query
def preprocess_meta(spark, sf_dir):
    counted = report.expansion_factor(
        _labelled(spark, sf_dir), tk.window_count(_count(), **WINDOW), by="lang"
    ).select(F.col("lang").alias("split"), "n_windows")
    meta = report.preprocess_meta(counted, _weights(spark, sf_dir), {"max_len": 66, "slide_stride": 16})
    per_split = F.transform(
        F.map_entries("counts"),
        lambda e: F.struct(F.lit("count").alias("section"), e["key"].alias("key"), e["value"].cast("double").alias("v")),
    )
    weights = F.transform(
        F.map_entries("class_weights"),
        lambda e: F.struct(F.lit("weight").alias("section"), e["key"].cast("string").alias("key"), _r6(e["value"]).alias("v")),
    )
    ids = F.transform(
        F.map_entries("label_to_id"),
        lambda e: F.struct(F.lit("label").alias("section"), e["key"].alias("key"), e["value"].cast("double").alias("v")),
    )
    return meta.select(F.inline(F.concat(per_split, weights, ids)))


REGS = (0.001, 0.01, 0.1, 1.0)


def _fitted(spark, sf_dir):
    """Classes from parts of the vectors, weighted for balance; a fifth of the items is for choosing."""
    rows_ = chunks(spark, sf_dir).select(
        F.concat(F.array(F.lit(1.0)), F.transform("logits", lambda v: v / 4)).alias("features"),
        F.col("y").cast("string").alias("label"), F.col("y").alias("label_id"), (F.col("id") % 5 == 0).alias("dev"),
    )
    weights = windows.class_weights(rows_.filter("NOT dev"))
    return exact_fit.fit_grid(
        windows.weight_column(weights, rows_), REGS, n_classes=3, n_features=4, focus=2, dev=F.col("dev"), steps=12
    )


@query
def ml_fit(spark, sf_dir):
    """Coefficients of every candidate, the same in any order of the rows."""
    fit = _fitted(spark, sf_dir)
    parts = [fit.coefficients(spark, c).withColumn("candidate", _big(F.lit(c))) for c in range(len(REGS))]
    found = reduce(DataFrame.unionByName, parts)
    return found.select("candidate", "feature", "class_id", _r6(F.col("value")).alias("value"))


@query
def ml_choose(spark, sf_dir):
    """F1 of every candidate on the rows held back, and which one is chosen."""
    return _fitted(spark, sf_dir).table(spark).withColumn("f1", _r6(F.col("f1")))


# ---- scores -----------------------------------------------------------------

@query
def softmax(spark, sf_dir):
    p = sc.softmax(F.col("logits"))
    return chunks(spark, sf_dir).select("id", "window_no", p.alias("p")).select(
        "id", "window_no", *[_r6(F.col("p")[i]).alias(f"p{i}") for i in range(3)]
    )


@query
def class_probs(spark, sf_dir):
    probs = sc.class_probs(sc.softmax(F.col("logits")), CLASSES)
    return chunks(spark, sf_dir).select(
        "id", "window_no", F.explode(probs).alias("label", "p")
    ).withColumn("p", _r6(F.col("p")))


def _chunk_p(spark, sf_dir) -> DataFrame:
    return pooling.chunk_probability(chunks(spark, sf_dir), 2).withColumn("y", sc.binary_target(F.col("y"), 2))


@query
def max_pool(spark, sf_dir):
    pooled = pooling.max_pool(_chunk_p(spark, sf_dir))
    return pooled.select("id", "context_id", _r6(F.col("score")).alias("score"), _big(F.col("y")).alias("y"))


@query
def best_window(spark, sf_dir):
    best = pooling.best_window(_chunk_p(spark, sf_dir))
    return best.select(
        "id", "context_id", "window_no", _r6(F.col("score")).alias("score"),
        _r6(F.col("probs")[0]).alias("p_bug"),
    )


@query
def macro_metrics(spark, sf_dir):
    pred = chunks(spark, sf_dir).withColumn("yhat", sc.argmax(F.col("logits")))
    out = evaluate.macro_metrics(pred, 2)
    return out.select(*[_r6(F.col(c)).alias(c) for c in out.columns])


def _curve(spark, sf_dir) -> DataFrame:
    return calibrate.pr_curve(scores(spark, sf_dir))


@query
def pr_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select(
        "score", "tp", "fp", _r6(F.col("precision")).alias("precision"), _r6(F.col("recall")).alias("recall")
    )


@query
def calibrate_threshold(spark, sf_dir):
    out = calibrate.calibrate_threshold(_curve(spark, sf_dir))
    return out.select(*[_r6(F.col(c)).alias(c) for c in out.columns])


def _dense_curve(spark, sf_dir) -> DataFrame:
    """Nearly as many distinct scores as line items."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = read(spark, sf_dir, "lineitem").select(
        (_big(key) * 7919 % 1000003 / F.lit(1000003.0)).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return calibrate.pr_curve(lines)


@query
def pr_curve_dense(spark, sf_dir):
    return _dense_curve(spark, sf_dir).select(
        "score", "tp", "fp", _r6(F.col("precision")).alias("precision"), _r6(F.col("recall")).alias("recall")
    )


@query
def calibrate_dense(spark, sf_dir):
    out = calibrate.calibrate_threshold(_dense_curve(spark, sf_dir), 0.3)
    return out.select(*[_r6(F.col(c)).alias(c) for c in out.columns])


def _predicted(spark, sf_dir) -> DataFrame:
    return evaluate.with_prediction(scores(spark, sf_dir), THRESHOLD)


@query
def binary_metrics(spark, sf_dir):
    out = evaluate.binary_metrics(_predicted(spark, sf_dir))
    rates = ("precision", "recall", "f1", "accuracy")
    return out.select(*[_r6(F.col(c)).alias(c) if c in rates else F.col(c) for c in out.columns])


@query
def confusion_matrix(spark, sf_dir):
    out = evaluate.confusion_matrix(_predicted(spark, sf_dir))
    return out.select("split", _big(F.col("y")).alias("y"), _big(F.col("yhat")).alias("yhat"), "n")


@query
def outcome_rows(spark, sf_dir):
    out = evaluate.outcome_rows(_predicted(spark, sf_dir), keep=["id", "split"])
    return out.select(
        "id", "split", "score_security", _big(F.col("y_pred_security")).alias("y_pred_security"),
        _big(F.col("y_true_security")).alias("y_true_security"), "type",
    )


@query
def outcome_counts(spark, sf_dir):
    return evaluate.outcome_counts(evaluate.outcome_rows(_predicted(spark, sf_dir), keep=["id"]))


@query
def score_histogram(spark, sf_dir):
    out = calibrate.score_histogram(scores(spark, sf_dir))
    return out.withColumn("y", _big(F.col("y")))


@query
def triage_band(spark, sf_dir):
    s = F.col("score")
    return scores(spark, sf_dir).select(
        "id", sc.triage_band(s, THRESHOLD).alias("band"),
        _big(sc.is_security(s, THRESHOLD).cast("int")).alias("is_security"),
    )


@query
def composite_key(spark, sf_dir):
    key = tx.composite_key(F.col("id"), F.col("context_id"))
    id_part, context_part = tx.split_key(key)
    return comments(spark, sf_dir).select(
        key.alias("key"), id_part.alias("id_part"), context_part.alias("context_part")
    )


def length_logits(texts: Column) -> Column:
    """Logits from the length of a window's text; stands in for a model."""
    return F.transform(
        texts,
        lambda t: F.array(F.lit(0.0), F.lit(0.0), (F.length(t) % 101) / F.lit(25.0) - 2),
    )


def _scored(spark, sf_dir, logits, tokenize=tk.tokenize) -> DataFrame:
    scored = pooling.score_comments(
        documents(spark, sf_dir), logits, CLASSES, THRESHOLD, max_len=66, overlap=16,
        version={"threshold": THRESHOLD}, tokenize=tokenize,
    )
    return scored.select(
        "id", "context_id", _r6(F.col("score_security")).alias("score_security"),
        _big(F.col("is_security").cast("int")).alias("is_security"), "band", "best_snippet",
        _r6(F.col("class_probs")["bug"]).alias("p_bug"),
        F.col("version")["threshold"].alias("version_threshold"),
    )


@query
def score_batch(spark, sf_dir):
    return _scored(spark, sf_dir, length_logits)


class WordTokenizer:
    """A plugged-in tokenizer: words between ASCII white space."""

    def load(self):
        return lambda text: [w for w in re.split(r"[ \t\n\r\f]+", text) if w]


class LengthScorer:
    """A plugged-in model that looks at the length of a window."""

    def load(self):
        return lambda texts: np.array([[0.0, 0.0, len(t) % 101 / 25 - 2] for t in texts])


@query
def plugin_tokens_scores(spark, sf_dir):
    """The same scores through a plugged-in tokenizer and model."""
    return _scored(
        spark, sf_dir, pooling.pandas_logits(LengthScorer()), pooling.pandas_tokenize(WordTokenizer())
    )


# ---- flows ------------------------------------------------------------------

@query
def triage_flow(spark, sf_dir):
    """Ingest, split and window the documents: what each class gets per split."""
    docs = documents(spark, sf_dir).select(
        F.md5("text").alias("id"), "text", "source", "context_id", "created_at",
        F.col("source").alias("comment_author"), F.col("title").alias("container_title"),
        F.col("labels").alias("container_labels"),
    )
    merged = flows.ingest([docs], NOW, noise=True)
    # Later steps read the merged documents more than once.
    merged = stage(merged.select("id", "text", "label", "source", "created_at", "context_id"), "merged")
    options = flows.WindowOptions(max_len=66, overlap=16)
    cut = flows.prepare(flows.split_documents(merged), options).windows
    per_doc = cut.groupBy("split", "label", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_windows")
    )


@query
def evaluate_flow(spark, sf_dir):
    """Chunk logits to metrics at the threshold calibrated on the dev split."""
    part = F.when(F.floor(F.col("id") / 10) % 2 == 0, "dev").otherwise("test")
    labelled = chunks(spark, sf_dir).withColumn("split", part)
    out = flows.evaluate_chunks(labelled, 2, 2, label="y", target=0.5).metrics
    rates = ("precision", "recall", "f1", "accuracy")
    return out.select(*[_r6(F.col(c)).alias(c) if c in rates else F.col(c) for c in out.columns])


# ---- files written and read back ---------------------------------------------

def _as_csv_rows(spark, sf_dir) -> DataFrame:
    """Documents as comment CSV rows; every cell is filled."""
    id_ = F.col("id").cast("string")
    rows_ = documents(spark, sf_dir).filter(F.length("text") > 0)
    filled = {c: F.concat(F.lit(f"{c} "), id_) for c in GITHUB_COLUMNS}
    filled |= {"repo": F.lit("o/r"), "comment_id": id_, "text": F.col("text")}
    return rows_.select(*[filled[c].alias(c) for c in GITHUB_COLUMNS], (F.col("id") % 2).alias("bare"))


@query
def csv_roundtrip(spark, sf_dir):
    """Whole texts, with quotes and line breaks, in files with and without a header."""
    path, rows_ = stage_path(spark, "csv"), _as_csv_rows(spark, sf_dir)
    sinks.write_comment_csv(rows_.filter("bare = 0"), path, GITHUB_COLUMNS)
    sinks.write_comment_csv(rows_.filter("bare = 1"), path, GITHUB_COLUMNS, header=False)
    back = read_comment_csv(spark, path)
    return back.select(_big(F.col("comment_id")).alias("id"), "text", "repo")


@query
def jsonl_roundtrip(spark, sf_dir):
    path = stage_path(spark, "jsonl")
    docs = documents(spark, sf_dir).select("id", "text", "lang")
    docs.write.json(path)
    return read_json_lines(spark, path, docs.schema)


@query
def core_projection(spark, sf_dir):
    text = F.col("event_type")
    rows_ = comments(spark, sf_dir).select(
        "id", text.alias("text"), F.lit("").alias("context"), F.lit("other").alias("label"), "created_at",
        "repo", "issue_number", "is_pr", "comment_type", "context_id", text.alias("comment_author"),
        F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("comment_url"),
        F.concat(F.lit("https://h/"), "repo").alias("container_url"), "score",
    )
    core = mapping.extended_core(rows_, "github")
    return core.withColumn("created_at", micros(F.col("created_at"))).withColumn("is_pr", _big(F.col("is_pr").cast("int")))


@query
def split_sink(spark, sf_dir):
    path = stage_path(spark, "splits")
    sinks.write_splits(_split_orders(spark, sf_dir), path, "o_orderdate", "o_orderkey")
    return spark.read.parquet(path).select("o_orderkey", "split")


@query
def window_sink(spark, sf_dir):
    path = stage_path(spark, "windows")
    docs = documents(spark, sf_dir).select("id", "text", F.col("lang").alias("split"))
    sinks.write_windows(windows.explode_windows(docs, **WINDOW), path)
    return spark.read.parquet(path).groupBy("split", "id").agg(F.count(F.lit(1)).alias("n_windows"))


@query
def score_sink(spark, sf_dir):
    path = stage_path(spark, "scores")
    sinks.write_scores(scores(spark, sf_dir), path)
    return spark.read.parquet(path).select("score", _big(F.col("y")).alias("y"))


@query
def outcome_csv(spark, sf_dir):
    path = stage_path(spark, "outcomes")
    sinks.write_outcomes(evaluate.outcome_rows(_predicted(spark, sf_dir), keep=["id", "split"]), path)
    schema = "id long, split string, score_security double, y_pred_security long, y_true_security long, type string"
    return spark.read.schema(schema).option("header", True).csv(path)


# ---- streams ----------------------------------------------------------------

def _drops(events: DataFrame) -> list[DataFrame]:
    """Four drops, newest first; a tenth of the ids of each comes again with the next."""
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    return [
        events.filter((week == k) | ((F.col("event_id") % 10 == 0) & (week == k + 1))) for k in (3, 2, 1, 0)
    ]


def _stream_drops(spark, sf_dir, name: str, indexed: bool = False, **options) -> str:
    """One run of the streaming ingest per drop, limits and index kept between them; gives
    the output folder. However many files a drop has, it is one batch."""
    base = stage_path(spark, name)
    events = read(spark, sf_dir, "events")
    index = LandedIndex(f"{base}/index", buckets=16) if indexed else None
    choose = LedgerSelection(Ledger(f"{base}/ledger", every=3), **options) if options else None
    for drop in _drops(events):
        drop.write.mode("append").parquet(f"{base}/in")
        stream = as_comments(streaming.stream_files(spark, f"{base}/in", events.schema))
        streaming.start_ingest(
            streaming.dedupe_stream(stream), f"{base}/rows", f"{base}/progress",
            None if choose else f"{base}/state", choose=choose, index=index,
        ).awaitTermination()
    return base


@query
def stream_ingest(spark, sf_dir):
    rows_ = spark.read.parquet(_stream_drops(spark, sf_dir, "stream_ingest") + "/rows")
    return rows_.select("id", "repo", micros(F.col("created_at")).alias("created_us"))


@query
def stream_state(spark, sf_dir):
    found = streaming.read_state(spark, _stream_drops(spark, sf_dir, "stream_state") + "/state")
    return found.select(
        "source", micros(F.col("newest_ts")).alias("newest_us"), micros(F.col("oldest_ts")).alias("oldest_us")
    )


@query
def stream_select(spark, sf_dir):
    """Two comments per item over four drops: earlier drops choose first."""
    base = _stream_drops(spark, sf_dir, "stream_select", k=2, policy="most-reacted")
    return spark.read.parquet(f"{base}/rows").select("id", "context_id")


@query
def stream_budget(spark, sf_dir):
    """Two comments per item and thirty per source over four drops."""
    base = _stream_drops(spark, sf_dir, "stream_budget", True, k=2, budget=30, updated="created_at")
    return spark.read.parquet(f"{base}/rows").select("id", "repo", "comment_type")


@query
def append_indexed(spark, sf_dir):
    """New comments by the index of landed ids, in three appends that overlap."""
    base = stage_path(spark, "append_indexed")
    index = LandedIndex(f"{base}/index", buckets=32)
    rows_ = comments(spark, sf_dir)
    landed_ids.append_indexed(landed(spark, sf_dir), f"{base}/rows", index)
    landed_ids.append_indexed(rows_.filter(F.dayofmonth("created_at") < 20), f"{base}/rows", index)
    index.compact(spark)
    landed_ids.append_indexed(rows_, f"{base}/rows", index)
    fresh = spark.read.parquet(f"{base}/rows").filter("batch_id > 0")
    return fresh.select("id", "repo", micros(F.col("created_at")).alias("created_us"))
