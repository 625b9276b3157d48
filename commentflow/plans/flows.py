"""The three jobs end to end: extract, prepare, evaluate.

Lazy, but for steps that rank over more than one partition (a budget above the
limit of Spark's window group limit, the pooled scores of an evaluation): these
stage a table while the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.constants import (
    MAX_LEN,
    OVERLAP,
    SPECIAL_TOKENS,
    SPLIT_RATIOS,
    TARGET_PRECISION,
)
from commentflow.functions import tokens as tk
from commentflow.functions.labels import build_context, weak_label
from commentflow.functions.scores import binary_target
from commentflow.functions.text import has_content, light_norm
from commentflow.functions.timecols import Instant, parse_ts
from commentflow.operators import calibrate, evaluate, filters, mapping, pooling, report, windows
from commentflow.operators.filters import is_body
from commentflow.operators.rows import container_rows, forum_rows
from commentflow.operators.select import policy_order, select_per_item, source_budget, top_k
from commentflow.operators.split import thread_split
from commentflow.operators.state import dedupe, unseen
from commentflow.operators.windows import TokenizeFn
from commentflow.session import stage
from commentflow.sources.files import restrict_sources


@dataclass(frozen=True)
class Window:
    """A time selection; see functions.timecols.window_bounds for the modes."""

    mode: str = "days"
    now: Instant = "1970-01-01 00:00:00"
    days: int | None = None
    since: Instant | None = None
    until: Instant | None = None
    from_days: int | None = None
    to_days: int | None = None

    def fresh(self, df: DataFrame, state: DataFrame | None, source: str, updated: str) -> DataFrame:
        return filters.fresh(
            df, self.mode, self.now, state, source, updated, since=self.since, until=self.until,
            days=self.days, from_days=self.from_days, to_days=self.to_days,
        )

    def apply(self, df: DataFrame, state: DataFrame | None, source: str, created: str) -> DataFrame:
        return filters.in_window(
            df, self.mode, self.now, state, source, created, since=self.since, until=self.until,
            days=self.days, from_days=self.from_days, to_days=self.to_days,
        )


def extract_issues(
    containers: DataFrame,
    window: Window,
    landed: DataFrame | None = None,
    state: DataFrame | None = None,
    sources: DataFrame | Sequence[str] | None = None,
    title_keywords: Iterable[str] = (),
    include: str = "comments",
    reviews: bool = False,
    per_item: int | None = None,
    budget: int | None = None,
    policy: str = "oldest",
    count_landed: bool = True,
) -> DataFrame:
    """New comment rows of landed issues and pull requests.

    ``count_landed``: whether landed comments take up places of ``per_item``.
    Containers without a change since the window's lower bound cannot hold new
    comments and are dropped before their entries are unnested.
    """
    if sources is not None:
        containers = restrict_sources(containers, sources)
    containers = filters.keep_keywords(containers, {"title": list(title_keywords)})
    timed = containers.withColumn("_changed", parse_ts(F.col("updatedAt")))
    containers = window.fresh(timed, state, "repo", "_changed").drop("_changed")
    rows = container_rows(
        containers, bodies=include != "comments", comments=include != "bodies",
        reviews=reviews and include != "bodies",
    ).withColumns({
        "created_at": parse_ts(F.col("comment_created_at")),
        "_updated": parse_ts(F.col("item_updated_at")),
    })
    rows = window.apply(rows, state, "repo", "created_at")
    if landed is not None and not count_landed:
        rows = unseen(rows, landed, "comment_id")
    body = is_body(F.col("comment_type"))
    if per_item is not None and per_item <= 0:
        chosen = rows.filter(body)
    else:
        # A body is an item of its own, so it takes up no comment's place.
        rows = rows.withColumn("_body", F.when(body, F.col("comment_id")))
        item = ("context_id", "_body")
        chosen = select_per_item(rows, per_item, policy, item, tie="comment_id").drop("_body")
    chosen = dedupe(chosen, "comment_id")
    if landed is not None and count_landed:
        chosen = unseen(chosen, landed, "comment_id")
    in_item = policy_order(policy, tie="comment_id")
    kept = source_budget(chosen, budget, updated="_updated", order_in_item=in_item, tie="comment_id")
    return kept.drop("_updated")


def extract_posts(
    submissions: DataFrame,
    window: Window,
    landed: DataFrame | None = None,
    state: DataFrame | None = None,
    sources: DataFrame | Sequence[str] | None = None,
    title_keywords: Iterable[str] = (),
    body_keywords: Iterable[str] = (),
    bodies: bool = False,
    per_post: int | None = None,
) -> DataFrame:
    """New comment rows of landed forum posts: the best scored live replies to
    each post, and optionally the posts' own texts. The window holds for posts
    and for replies."""
    if sources is not None:
        submissions = restrict_sources(submissions, sources, "subreddit")
    posts = filters.keep_keywords(
        submissions, {"title": list(title_keywords), "selftext": list(body_keywords)}
    )
    timed = posts.withColumn("_posted", F.timestamp_seconds("created_utc"))
    posts = window.apply(timed, state, "subreddit", "_posted").drop("_posted")
    rows = forum_rows(posts, bodies=bodies).withColumn("created_at", parse_ts(F.col("comment_created_utc")))
    rows = window.apply(rows, state, "subreddit", "created_at")
    rows = dedupe(rows, "comment_id")
    if landed is not None:
        rows = unseen(rows, landed, "comment_id")
    own = F.col("parent_id").isNull()
    live = filters.top_level(F.col("parent_id")) & ~filters.removed(F.col("comment_body"))
    # A post's own text is a group of its own, so it takes up no reply's place.
    rows = rows.filter(own | live).withColumn("_own", F.when(own, F.col("comment_id")))
    if per_post is not None and per_post <= 0:
        return rows.filter(own).drop("_own")
    order = [F.col("score").desc(), F.col("comment_id").asc()]
    keys = ["subreddit", "submission_id", "_own"]
    return top_k(rows, keys, order, per_post, "comment_id").drop("_own")


def backfill_posts(
    submissions: DataFrame, state: DataFrame, start: Instant, landed: DataFrame | None = None
) -> DataFrame:
    """All replies of posts from ``start`` on that lie before the source's mark."""
    posts = submissions.withColumn("_created", F.timestamp_seconds("created_utc"))
    old = filters.backfill(posts, state, start, "subreddit", "_created").drop("_created")
    rows = dedupe(forum_rows(old, bodies=False), "comment_id")
    return rows if landed is None else unseen(rows, landed, "comment_id")


def ingest(
    inputs: Sequence[DataFrame],
    now: Instant,
    noise: bool = False,
    build_core: bool = True,
    drop_empty: bool = True,
    default_source: str | None = None,
) -> DataFrame:
    """Inputs of any known layout to one deduplicated, normalised table."""
    mapped = [
        mapping.normalize_time(mapping.to_core(df, now, None, default_source), now) for df in inputs
    ]
    merged = mapping.union_inputs(mapped)
    if noise and "comment_author" in merged.columns:
        # Before the shuffle of the dedupe, which then moves less.
        merged = filters.drop_noise(merged)
    merged = dedupe(merged).drop("src_ord")
    if drop_empty:
        # On the raw text: a filter on the normalised one would be pushed
        # below it and normalise every text twice.
        merged = merged.filter(has_content(F.col("text")))
    merged = merged.withColumn("text", light_norm(F.col("text")))
    titled = {"container_title", "container_labels"} <= set(merged.columns)
    label = F.lit("other")
    if build_core:
        title, labels = F.col("container_title"), F.col("container_labels")
        if titled:
            label = weak_label(F.col("text"), title, labels)
        merged = merged.withColumn("context", build_context(title, labels) if titled else F.lit(""))
    return merged.withColumn("label", F.coalesce(F.col("label"), label))


@dataclass(frozen=True)
class WindowOptions:
    max_len: int = MAX_LEN
    overlap: int = OVERLAP
    max_windows: int | None = None
    special: int = SPECIAL_TOKENS
    max_input_tokens: int | None = None
    sliding: bool = True
    domain_prefix: bool = False
    tokenize: TokenizeFn = tk.tokenize


@dataclass(frozen=True)
class Prepared:
    documents: DataFrame
    windows: DataFrame
    weights: DataFrame
    expansion: DataFrame


def split_documents(merged: DataFrame, ratios: Sequence[float] = SPLIT_RATIOS) -> DataFrame:
    return thread_split(merged, ratios)


def prepare(documents: DataFrame, options: WindowOptions = WindowOptions()) -> Prepared:
    """Split documents to token windows and the weights of the train classes.

    Weights count windows, not documents, and are found from token counts, so
    the windows themselves are built once.
    """
    docs = documents.select("id", "text", "label", "source", "created_at", "context_id", "split")
    if options.domain_prefix:
        docs = windows.with_domain_prefix(docs)
    cut = dict(max_len=options.max_len, overlap=options.overlap, max_windows=options.max_windows, special=options.special)
    tokens = options.tokenize(F.col("text"))
    counted = docs.withColumn("_n", F.size(tokens))
    n_windows = tk.window_count(F.col("_n"), **cut) if options.sliding else F.lit(1)
    if options.max_input_tokens is not None:
        n_windows = F.when(F.col("_n") + options.special <= options.max_input_tokens, n_windows)
    return Prepared(
        documents=docs,
        windows=windows.explode_windows(
            docs, tokenize=options.tokenize, sliding=options.sliding,
            max_input_tokens=options.max_input_tokens, **cut,
        ),
        weights=windows.class_weights(counted.filter(F.col("split") == "train"), count=n_windows),
        expansion=report.expansion_factor(counted, n_windows),
    )


@dataclass(frozen=True)
class Evaluation:
    scores: DataFrame
    threshold: DataFrame
    metrics: DataFrame
    outcomes: DataFrame


def evaluate_chunks(
    chunks: DataFrame,
    class_index: int,
    positive: str | int,
    label: str = "label",
    calibrate_on: str = "dev",
    target: float = TARGET_PRECISION,
) -> Evaluation:
    """Chunk logits per split to a calibrated threshold, metrics and outcomes.

    The threshold stays a scalar subquery, so nothing passes the driver.
    """
    scored = pooling.chunk_probability(chunks, class_index).withColumn(
        "y", binary_target(F.col(label), positive)
    )
    # One narrow row per comment, which the curve, metrics, outcomes and scores share.
    pooled = stage(pooling.max_pool(scored, ("split", "id", "context_id")), "pooled")
    curve = calibrate.pr_curve(pooled.filter(F.col("split") == calibrate_on))
    threshold = calibrate.calibrate_threshold(curve, target)
    predicted = evaluate.with_prediction(pooled, threshold.select("threshold").scalar())
    return Evaluation(
        scores=pooled,
        threshold=threshold,
        metrics=evaluate.binary_metrics(predicted),
        outcomes=evaluate.outcome_rows(predicted, ("split", "id", "context_id")),
    )
