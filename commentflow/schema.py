"""Schemas of each stage."""

from pyspark.sql import types as T

from commentflow.constants import GITHUB_COLUMNS, REDDIT_COLUMNS

GITHUB_CSV = T.StructType([T.StructField(c, T.StringType()) for c in GITHUB_COLUMNS])
REDDIT_CSV = T.StructType([T.StructField(c, T.StringType()) for c in REDDIT_COLUMNS])

CORE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("context_id", T.StringType()),
])

_COMMENT = (
    "id:string, url:string, bodyText:string, createdAt:string, updatedAt:string, "
    "isMinimized:boolean, author:struct<login:string>, "
    "reactionGroups:array<struct<content:string, users:struct<totalCount:bigint>>>"
)
_NODE = (
    "number:bigint, title:string, url:string, state:string, createdAt:string, updatedAt:string, "
    "mergedAt:string, author:struct<login:string>, labels:struct<nodes:array<struct<name:string>>>, "
    f"bodyText:string, comments:struct<nodes:array<struct<{_COMMENT}>>>, "
    "reviewThreads:struct<nodes:array<struct<id:string, isResolved:boolean, "
    f"comments:struct<nodes:array<struct<{_COMMENT}>>>>>>"
)
# DDL text, so that the module loads without a session.
# One landed issue or pull request with its comments and review threads.
CONTAINER = f"struct<repo:string, is_pr:boolean, {_NODE}>"
# One landed page: the containers of one repository.
CONTAINER_PAGE = f"struct<repo:string, is_pr:boolean, nodes:array<struct<{_NODE}>>>"
# One landed forum post with its comments.
SUBMISSION = (
    "struct<subreddit:string, id:string, title:string, selftext:string, author:string, "
    "permalink:string, created_utc:double, comments:array<struct<id:string, parent_id:string, "
    "body:string, author:string, permalink:string, score:bigint, created_utc:double>>>"
)
# Newest and oldest comment seen per source; the backfill mark is oldest_ts.
SOURCE_STATE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("newest_ts", T.TimestampType()),
    T.StructField("oldest_ts", T.TimestampType()),
])
WINDOWS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("window_no", T.IntegerType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
])
CHUNK_SCORES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("logits", T.ArrayType(T.DoubleType())),
])
SCORE_REQUEST = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("context_id", T.StringType()),
])
