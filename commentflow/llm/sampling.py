"""A bounded choice of distinct texts to learn from, per class and the same on every run.

Texts are chosen by hash. Only narrow rows (class, hash, digest) are grouped and ranked:
a class with more distinct texts than wanted is first cut to those whose hash lies below
a bound that leaves about twice as many, so no task ranks more than that per class. The
chosen digests meet the table again in a join, and copies are dropped where they are
read: the texts of other rows never move. A text counts once, whatever its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentflow.session import stage

_TOP = float(1 << 63)
BROADCAST_ROWS = 500_000  # digests of 16 bytes


def hashes(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """Columns ``more`` with hash ``h`` and digest ``d`` of every text; null texts are left out."""
    some = docs.filter(F.col(text).isNotNull())
    return some.select(*more, F.xxhash64(text).alias("h"), F.unhex(F.md5(text)).alias("d"))


def fewest(once: DataFrame, most: int) -> DataFrame:
    """Of distinct rows with a class ``k``, at most ``most`` per class, by hash."""
    once = stage(once, "sample-hashes")
    sizes = once.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    place = F.col("h").bitwiseAND(F.lit((1 << 63) - 1))
    below = place < F.least(F.lit(_TOP), F.lit(_TOP) * (2 * most + 100) / F.col("_n"))
    first = W.partitionBy("k").orderBy("h", "d")
    few = once.join(F.broadcast(sizes), "k").filter(below)  # sizes: one row per class
    ranked = few.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= most)
    return stage(ranked.drop("_n", "_place", "h"), "sample")


def texts_of(docs: DataFrame, text: str, chosen: DataFrame) -> DataFrame:
    """The chosen rows with their ``text``, each once."""
    wanted = chosen.select("d").distinct()
    # At most ``most`` digests per class: where that is within the bound, no text is shuffled.
    if chosen.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    digested = docs.filter(F.col(text).isNotNull()).select(F.unhex(F.md5(text)).alias("d"), F.col(text).alias("text"))
    once = digested.join(wanted, "d").groupBy("d").agg(F.first("text").alias("text"))
    return chosen.join(once, "d").drop("d")
