"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table holds, per slot, a bit for every language: the AND of an n-gram's slots
names all languages that contain it (or seem to). Per language the hits of a text
are counted, corrected by the filter's own rate of false positives, and the
language with the largest corrected share wins.

Filters are learned from at most ``per_language`` distinct texts of each language (a
documented bound, chosen by hash; copies count once); n-grams of a single learning
text are left out as noise, unless the language has few texts. The filter has a fixed
size, whatever the input. Everything else reads whole texts, each in one task (about 80
bytes a byte of it). Null texts and texts without a letter are ``und`` with score 0;
ties go to the first language in code-point order; without anything learned every text
is ``und``. Rows that repeat give a row each. Input columns beyond those named are
ignored; kept ones must not be called ``lang_pred`` or ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.llm.batches import slices
from commentflow.llm.sampling import fewest, hashes, texts_of
from commentflow.llm.shingles import mix, text_bytes

GRAM = 5
SLOTS = 1 << 20
WORD = 62  # languages per mask
FEW = 20  # with fewer learning texts a language keeps n-grams of a single one

# Everything in ASCII but letters becomes a space; other bytes stay.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of all texts, padded with spaces, and the text of
    each; n-grams of spaces only or with two spaces in a row inside are left out."""
    data, starts = text_bytes(texts)
    n = np.diff(starts)
    wide = np.full(len(data) + 4 * len(n), 32, np.uint8)
    shift = starts[:-1] + 4 * np.arange(len(n)) + 2
    wide[np.arange(len(data)) + np.repeat(shift - starts[:-1], n)] = _PLAIN[data]
    m = max(len(wide) - GRAM + 1, 0)
    value = np.zeros(m, np.uint64)
    for k in range(GRAM):
        value = value << np.uint64(8) | wide[k : k + m].astype(np.uint64)
    blank = wide == 32
    twice = blank[:-1] & blank[1:]
    good = np.ones(m, bool)
    for k in range(1, GRAM - 2):
        good &= ~twice[k : k + m]
    good &= ~(twice[:m] & twice[GRAM - 2 : GRAM - 2 + m])
    text = np.repeat(np.arange(len(n)), n + 4)[:m]
    good &= text == np.repeat(np.arange(len(n)), n + 4)[GRAM - 1 : GRAM - 1 + m]
    return mix(value[good]), text[good]


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(SLOTS - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2000):
    """Languages and the slot table, from rows with a text and a language."""
    some = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.lower(text).alias("text")
    )
    chosen = fewest(hashes(some, "text", F.col("lang").alias("k")).distinct(), per_language)
    sizes = chosen.groupBy(F.col("k").alias("lang")).agg((F.count(F.lit(1)) < FEW).alias("few"))
    sample = texts_of(some, "text", chosen).withColumnRenamed("k", "lang")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                h, at = grams(batch.column("text"))
                both = np.unique(np.stack([at.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(pa.array(both[0].astype(np.int64))), pa.array(both[1].view(np.int64))],
                    ["lang", "gram"],
                )

    languages = sorted(r.lang for r in some.select("lang").distinct().collect())
    place = F.array_position(F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>"), F.col("lang")) - 1
    known = (
        sample.mapInArrow(run, "lang string, gram long").groupBy("lang", "gram").count()
        .join(sizes, "lang").filter("count > 1 OR few")
        .withColumn("_place", place)
    )
    mask = F.expr(f"shiftleft(1L, cast(_place % {WORD} as int))")
    slot = F.array(
        F.col("gram").bitwiseAND(F.lit(SLOTS - 1)),
        F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(SLOTS - 1)),
    )
    rows = (
        known.select((F.col("_place") / WORD).cast("int").alias("word"), F.explode(slot).alias("slot"), mask.alias("mask"))
        .groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    table = np.zeros((len(languages) // WORD + 1, SLOTS), np.uint64)
    table[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return languages, table


def predict(docs: DataFrame, model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Per input row: the kept columns, ``lang_pred`` and ``score``."""
    languages, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # SLOTS masks: a fixed size
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("a kept column has the name of a result")
    kept = docs.select(
        *keep, F.lower(text).alias("_lower"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    )

    def run(batches):
        table = shared.value
        share = [
            np.count_nonzero(table[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) / SLOTS for i in range(len(languages))
        ]
        false = np.array(share) ** 2
        names = pa.array([*languages, "und"], pa.string())
        for whole in batches:
            for batch in slices(whole, "_lower"):
                h, at = grams(batch.column("_lower"))
                a, b = _slots(h)
                n = np.bincount(at, minlength=batch.num_rows)
                found = np.zeros((len(languages), batch.num_rows))
                for w in range(len(table) if len(h) else 0):
                    mask = table[w][a] & table[w][b]
                    for i in range(w * WORD, min(len(languages), (w + 1) * WORD)):
                        hit = (mask >> np.uint64(i % WORD) & np.uint64(1)).astype(np.float64)
                        found[i] = np.bincount(at, weights=hit, minlength=batch.num_rows)
                true = (found / np.maximum(n, 1) - false[:, None]) / (1 - np.minimum(false, 0.999))[:, None]
                letters = batch.column("_letters").to_numpy(zero_copy_only=False) & (len(languages) > 0)
                best = np.argmax(true, axis=0) if len(languages) else np.zeros(batch.num_rows, int)
                top = true[best, np.arange(batch.num_rows)] if len(languages) else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in keep],
                        names.take(pa.array(np.where(letters, best, len(languages)))),
                        pa.array(np.where(letters, np.clip(top, 0, 1), 0.0)),
                    ],
                    [*keep, "lang_pred", "score"],
                )

    schema = kept.drop("_lower", "_letters").schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)
