"""Benchmark decontamination by winnowing.

A document is contaminated where it holds ``span`` words in a row of a benchmark
item, or the whole of an item of fewer words. Words are runs of ASCII letters (in
lower case), digits and characters beyond ASCII.

Of every ``span`` words, winnowing keeps the smallest of the hashes of their runs of
``GRAM`` words (the last of equal ones): neighbouring windows mostly keep the same
one, so about two in seven runs are kept, and equal spans of that length always share
a kept hash at the same place. Items shorter than ``span`` are winnowed with their own
length. The kept hashes of the items set bits in a map of at most ``MOST_BITS`` bits,
which is broadcast (8 MB at most, whatever the benchmark's size); documents keep those
of their hashes whose bit is set, with the words of the windows they stand for. Those
fingerprints are joined with the items' by hash and extended to whole windows, compared
word by word. On the item side every window is one row with the set of its items, so a
passage that many documents and many items share makes one row per occurrence.

Null and empty texts have no words and no hits; items without words have no windows.
Rows that repeat an id, or are equal, each give their own row. An item whose id is
null marks words but is not counted or listed; items that repeat an id count once.
Texts are never cut: one text needs about 60 bytes a byte in its task, and the
documents' hits one row per hit word. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.llm.batches import slices
from commentflow.llm.shingles import _BASE, _LOWER, _UNBASE, _powers, mix, text_bytes
from commentflow.session import stage

SPAN = 10
GRAM = 5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26
_SLICE = 1 << 20  # bytes of text hashed at a time
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_HITS = "array<struct<n: int, hash: bigint, start: int, words: array<string>>>"


@cache
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, size), _powers(_UNBASE, size)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 2 * _SLICE:
        return _powers(_BASE, n), _powers(_UNBASE, n)  # one very long text: not kept
    return tuple(t[:n] for t in _power_tables(2 * _SLICE))


def words_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """All texts' lower-case bytes, begin, end and hash of every word, and per text
    the number of words before it."""
    data, starts = text_bytes(texts)
    data = _LOWER[data]
    solid = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True  # texts lie side by side
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    first, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    power, back = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return data, first, end, mix((sums[end] - sums[first]) * back[first]), np.searchsorted(first, starts)


def _winnowed(grams: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the run that each window keeps; ``starts`` are the windows'."""
    best, place = grams[starts], starts.copy()
    for k in range(1, span - gram + 1):
        other = grams[starts + k]
        take = other <= best
        best = np.where(take, other, best)
        place = np.where(take, starts + k, place)
    return place, best


def fingerprints(texts: pa.Array, lengths: Sequence[int], whole: bool, bits: np.ndarray | None) -> tuple[list[int], list[list[dict]]]:
    """Number of words and kept fingerprints of every text, for windows of each length.

    ``whole``: windows below the span count only as a whole text (the items' side).
    ``bits``: a packed map; fingerprints whose bit is not set are left out.
    """
    data, first, end, hashes, at = words_of(texts)
    count = np.diff(at)
    owner = np.repeat(np.arange(len(count)), count)
    left = at[1:][owner] - np.arange(len(first))  # words from here to the end of the text
    padded = np.concatenate([hashes, np.zeros(GRAM, np.uint64)])
    found: list[list[dict]] = [[] for _ in count]
    for span in lengths:
        gram = min(GRAM, span)
        if whole and span < SPAN:
            starts = at[:-1][count == span]
        else:
            starts = np.flatnonzero(left >= span)
        if not len(starts):
            continue
        grams = np.zeros(len(hashes), np.uint64)
        for k in range(gram):
            grams = mix(grams + padded[k : k + len(hashes)] + np.uint64(k + 1))
        place, best = _winnowed(grams, starts, span, gram)
        fresh = np.ones(len(place), bool)  # windows in a row that keep the same run
        fresh[1:] = (place[1:] != place[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
        new = np.flatnonzero(fresh)
        last = np.append(new[1:], len(place)) - 1
        if bits is not None:
            slot = best[new] & np.uint64(8 * len(bits) - 1)
            hit = bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
            new, last = new[hit], last[hit]
        for a, b in zip(new.tolist(), last.tolist(), strict=True):
            s, e = int(starts[a]), int(starts[b]) + span
            found[owner[s]].append({
                "n": span, "hash": int(best[a].view(np.int64)), "start": s - int(at[owner[s]]),
                "words": [data[first[i] : end[i]].tobytes().decode("utf-8", "replace") for i in range(s, e)],
            })
    return count.tolist(), found


def _fingerprinted(df: DataFrame, id_col: str, text: str, lengths: Sequence[int], whole: bool, bits=None) -> DataFrame:
    """Rows (id, n_words, hits), one per input row."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                count, found = fingerprints(part.column("text"), lengths, whole, packed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(count, pa.int64()), pa.array(found, kind)], ["id", "n_words", "hits"]
                )

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_words long, hits {_HITS}")


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """The hits extended to windows: (n, hash, start, words as one string)."""
    hit = rows.select(*keep, F.explode("hits").alias("h")).select(*keep, "h.*")
    each = F.posexplode(F.expr(
        "transform(sequence(0, size(words) - n), i -> array_join(slice(words, i + 1, n), ' '))"
    )).alias("k", "window")
    return hit.select(*keep, "n", "hash", "start", each).select(
        *keep, "n", "hash", (F.col("start") + F.col("k")).alias("start"), "window"
    )


def _bit_map(tests: DataFrame):
    """The items' hashes as a packed map, about 16 bits per hash within the bounds."""
    hashes = tests.select("hash").distinct()
    bits = min(max(LEAST_BITS, 1 << int(16 * hashes.count()).bit_length()), MOST_BITS)
    slot = F.expr(f"hash & {bits - 1}L")
    words = hashes.groupBy((slot.bitwiseAND(F.lit(-64)) / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63L AS int))")).alias("word")
    ).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return out.astype("<i8").tobytes()


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside an item's window),
    ``n_items``, ``items_sha256`` (of the sorted ids, joined by commas), ``contaminated``."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    rows = _fingerprinted(named, "id", "text", range(1, SPAN + 1), True)
    listed = F.sort_array(F.collect_set("id"))
    tests = _windows(rows, "id").groupBy("n", "hash", "window").agg(listed.alias("items"))
    tests = stage(tests.withColumn("set", F.sha2(F.to_json("items"), 256)), "winnow_items")
    lengths = sorted(r.n for r in tests.select("n").distinct().collect())
    bits = spark.sparkContext.broadcast(_bit_map(tests))

    marked = _fingerprinted(docs, id_col, text, lengths, False, bits).withColumn("row", F.monotonically_increasing_id())
    marked = stage(marked, "winnow_docs")
    shared = stage(
        _windows(marked, "row").join(tests.select("n", "hash", "window", "set"), ["n", "hash", "window"])
        .select("row", "start", "n", "set"), "winnow_hits",
    )
    # Words covered: what each window adds to those that begin before it.
    reach = F.expr("max(start + n) OVER (PARTITION BY row ORDER BY start, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    hit = shared.withColumn("reach", F.coalesce(reach, F.lit(0))).groupBy("row").agg(
        F.sum(F.expr("greatest(0, start + n - greatest(start, reach))")).cast("long").alias("n_hit")
    )
    sets = tests.groupBy("set").agg(F.first("items").alias("items"))
    held = (
        shared.select("row", "set").distinct().join(sets, "set")
        .select("row", F.explode("items").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        marked.select("row", F.col("id").alias(id_col), "n_words")
        .join(hit, "row", "left").join(held, "row", "left")
        .withColumn("items", F.coalesce("items", none))
        .select(
            id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
