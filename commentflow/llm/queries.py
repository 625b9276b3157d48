"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentflow.llm import align, langid, licenses, merkle, mixing, multi_index, ngram_join, pieces, pii, quality, toxicity, warc, winnow
from commentflow.plans.tables import read
from commentflow.session import stage_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality ledger of every document, with the verdict of the current policy."""
    rows = quality.ledger(read(spark, sf_dir, "documents"))
    rows = quality.apply_policy(rows, quality.POLICIES["base-1"], "base_kept")
    rows = quality.apply_policy(rows, quality.POLICIES["prose-1"], "kept")
    return rows.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "NOT base_kept AS base_failed", "kept", "n_lines", "n_upper", "n_marks", "fail_bits",
    )


PIECES = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECES, decoded="decoded").select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    target = stage_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), target)
    return warc.read(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector."""
    return multi_index.near_duplicates(read(spark, sf_dir, "embeddings"))


PII_KEY = os.environ.get("PII_KEY", "surrogates-1")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced, and how many entities it had."""
    return pii.replace(read(spark, sf_dir, "documents"), PII_KEY, found="n_found")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and near-duplicate component of every document."""
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document text and line that is a known licence text or notice."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def _fold(of: int):
    """crc32 of the id as text, by which rows are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % of


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a quarter of the ids is held out of fitting."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_fold(4) != 2)
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", _fold(4) == 2), model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of the ids is held out of fitting."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", _fold(3) == 1)
    return langid.predict(docs, langid.learn(docs.filter("NOT held_out")), ("doc_id", "held_out"))


BYTE_TOKENS = os.environ.get("BYTE_TOKENS", "/opt/tokenizers/byte_bpe_50k.json")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and piece tokens of every document."""
    docs = read(spark, sf_dir, "documents")
    return align.align(docs, BYTE_TOKENS, PIECES, printed="sha256").withColumnRenamed("groups", "groups_sha256")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents; a third of the ids is checked with a lower-cased text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return merkle.manifest(
        read(spark, sf_dir, "documents"), altered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
        shown=F.translate("text", upper, upper.lower()),
    )


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of a benchmark item."""
    return winnow.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_pieces, op3_warc, op4_multi_index, op5_pii, op6_ngram_join, op7_licenses, op8_toxicity, op9_mixing, op10_langid, op11_alignment, op12_merkle, op13_winnowing)}
