"""Comment rows from nested containers, in one pass over the landed data.

A container's own text, comments and review comments become one array of small
entries, unnested once; the columns they share with the container are put on
afterwards, in compiled code. A page of payloads is thus read a single time
whatever mix of rows is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.functions.labels import join_labels
from commentflow.functions.scores import reaction_sum
from commentflow.functions.text import is_blank
from commentflow.functions.timecols import iso

# Entries carry their exact types, so that no cast has to copy the arrays.
_ENTRY = {
    "kind": "string", "thread_id": "string", "node_id": "string", "url": "string",
    "text": "string", "created": "string", "author": "string", "reactions": "bigint",
}
_REPLY = {
    "own": "boolean", "node_id": "string", "parent_id": "string", "author": "string",
    "body": "string", "link": "string", "score": "bigint", "created": "double",
}
# Fixed value: links of the forum are relative to this address.
FORUM_URL = "https://www.reddit.com"


def explode_pages(pages: DataFrame) -> DataFrame:
    """Landed pages to one row per container, with repo and is_pr of the page.

    The outer form keeps Spark from testing the array's size first, which
    would parse a payload held as text twice.
    """
    nodes = pages.select("repo", "is_pr", F.inline_outer("nodes"))
    return nodes.filter(F.col("number").isNotNull())


def _entry(fields: dict[str, str], *values: Column) -> Column:
    return F.struct(*[v.cast(kind).alias(name) for (name, kind), v in zip(fields.items(), values)])


def _no_entries(fields: dict[str, str]) -> Column:
    inner = ",".join(f"{name}:{kind}" for name, kind in fields.items())
    return F.array().cast(f"array<struct<{inner}>>")


def _own_entry() -> Column:
    return _entry(
        _ENTRY, F.lit("body"), F.lit(None), F.lit(None), F.col("url"), F.col("bodyText"),
        F.col("createdAt"), F.col("author.login"), F.lit(0),
    )


def _node_entry(kind: str, node: Column, thread_id: Column) -> Column:
    return _entry(
        _ENTRY, F.lit(kind), thread_id, node["id"], node["url"], node["bodyText"], node["createdAt"],
        node["author"]["login"], reaction_sum(node["reactionGroups"]),
    )


def _comment_entries() -> Column:
    return F.transform("comments.nodes", lambda c: _node_entry("comment", c, F.lit(None)))


def _review_entries() -> Column:
    def of_thread(thread: Column) -> Column:
        return F.transform(
            thread["comments"]["nodes"], lambda c: _node_entry("review", c, thread["id"])
        )

    return F.when(F.col("is_pr"), F.flatten(F.transform("reviewThreads.nodes", of_thread)))


def container_rows(
    containers: DataFrame, bodies: bool = True, comments: bool = True, reviews: bool = True
) -> DataFrame:
    """Issue and pull-request containers to comment rows.

    Columns: the 16 of the comment CSV, then thread_id, reactions and
    item_updated_at, which orders items also where container columns are null
    (review comments have none).
    """
    empty = _no_entries(_ENTRY)
    wanted = [
        *([F.array(_own_entry())] if bodies else []),
        *([_comment_entries()] if comments else []),
        *([_review_entries()] if reviews else []),
    ]
    if not wanted:
        raise ValueError("choose bodies, comments or reviews")
    entries = F.concat(*[F.coalesce(part, empty) for part in wanted])
    parent = ["repo", "is_pr", "number", "title", "state", "url", "createdAt", "updatedAt"]
    flat = containers.select(
        *[F.col(c).alias(f"_{c}") for c in parent],
        join_labels(F.transform("labels.nodes", lambda x: x["name"])).alias("_labels"),
        F.inline(entries),
    )
    pr, number, kind = F.col("_is_pr"), F.col("_number").cast("string"), F.col("kind")
    row_id = (
        F.when((kind == "body") & pr, F.concat(F.lit("github_prbody_"), "_repo", F.lit("#"), number))
        .when(kind == "body", F.concat(F.lit("github_issuebody_"), "_repo", F.lit("#"), number))
        .when(kind == "review", F.concat(F.lit("github_pr_reviewcomment_"), "node_id"))
        .when(pr, F.concat(F.lit("github_pr_issuecomment_"), "node_id"))
        .otherwise(F.concat(F.lit("github_issuecomment_"), "node_id"))
    )
    row_type = (
        F.when((kind == "body") & pr, "pr_body")
        .when(kind == "body", "issue_body")
        .when(kind == "review", "review_comment")
        .otherwise("issue_comment")
    )

    def of_container(name: str) -> Column:
        return F.when(kind != "review", F.col(name))

    return flat.select(
        F.col("_repo").alias("repo"),
        pr.alias("is_pr"),
        F.col("_number").alias("issue_number"),
        row_type.alias("comment_type"),
        row_id.alias("comment_id"),
        F.col("created").alias("comment_created_at"),
        F.col("author").alias("comment_author"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("url").alias("comment_url"),
        F.concat("_repo", F.when(pr, "#pr:").otherwise("#issue:"), number).alias("context_id"),
        of_container("_title").alias("container_title"),
        of_container("_state").alias("container_state"),
        of_container("_url").alias("container_url"),
        of_container("_createdAt").alias("container_created_at"),
        of_container("_updatedAt").alias("container_updated_at"),
        of_container("_labels").alias("container_labels"),
        "thread_id",
        "reactions",
        F.col("_updatedAt").alias("item_updated_at"),
    )


def forum_rows(submissions: DataFrame, bodies: bool = True, comments: bool = True) -> DataFrame:
    """Forum posts to comment rows; a post with text gives a row of its own.

    Columns: the 10 of the comment CSV, parent_id and score.
    """
    own = _entry(
        _REPLY, F.lit(True), F.lit(None), F.lit(None), F.col("author"), F.col("selftext"),
        F.col("permalink"), F.lit(None), F.col("created_utc"),
    )

    def reply(c: Column) -> Column:
        return _entry(
            _REPLY, F.lit(False), c["id"], c["parent_id"], c["author"], c["body"], c["permalink"],
            c["score"], c["created_utc"],
        )

    wanted = [
        *([F.when(~is_blank(F.col("selftext")), F.array(own))] if bodies else []),
        *([F.transform("comments", reply)] if comments else []),
    ]
    if not wanted:
        raise ValueError("choose bodies or comments")
    empty = _no_entries(_REPLY)
    parent = ["subreddit", "id", "title", "permalink", "created_utc"]
    flat = submissions.select(
        *[F.col(c).alias(f"_{c}") for c in parent],
        F.inline(F.concat(*[F.coalesce(part, empty) for part in wanted])),
    )
    address = F.lit(FORUM_URL)
    body_id = F.concat(F.lit("reddit_postbody_"), "_id")
    return flat.select(
        F.col("_subreddit").alias("subreddit"),
        F.col("_id").alias("submission_id"),
        iso(F.timestamp_seconds("_created_utc")).alias("submission_created_utc"),
        F.col("_title").alias("submission_title"),
        F.when(F.col("own"), body_id).otherwise(F.col("node_id")).alias("comment_id"),
        iso(F.timestamp_seconds(F.coalesce("created", "_created_utc"))).alias("comment_created_utc"),
        F.col("author").alias("comment_author"),
        F.coalesce("body", F.lit("")).alias("comment_body"),
        F.concat(address, F.coalesce("link", "_permalink")).alias("comment_permalink"),
        F.concat(address, "_permalink").alias("submission_url"),
        "parent_id",
        "score",
    )


def join_containers(
    comments: DataFrame, containers: DataFrame, comment_key: str, container_key: str
) -> DataFrame:
    """Container columns on each comment, when the two are landed apart."""
    return comments.join(containers, F.col(comment_key) == F.col(container_key))
