"""Quality rules kept as a ledger of bits.

Each rule is evaluated once per document. The ledger row holds the measurements
and one failure bit per rule; policies are versioned sets of rules, applied
later with a bitwise AND, and ablations come from the histogram of bit patterns,
so neither reads a text again.

Null and empty texts have zero for every measurement and fail the word-count
rule. Repeated rows give repeated ledger rows. Columns of the input that are not
asked for in ``keep`` are left out, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.llm.words import words

@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements, in whole numbers


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 10 * n_words"),
    Rule("short_words", 3, "word_chars < 2 * n_words"),
    Rule("long_words", 4, "word_chars > 20 * n_words"),
    Rule("duplicate_lines", 5, "100 * n_dup_lines > 60 * n_lines"),
    Rule("upper_case", 6, "100 * n_upper > 40 * word_chars"),
    Rule("loud_marks", 7, "100 * n_marks > 50 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules: a document that fails any of them is rejected."""

    version: str
    rules: tuple[str, ...] = field(default=tuple(r.name for r in RULES))

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = {
    "base-1": Policy("base-1", BASE),
    "prose-1": Policy("prose-1"),
}


def _pairs(arr: str, step: str) -> str:
    """``zip_with`` of an array and itself one place on; ``step`` is the lambda."""
    n = f"greatest(size({arr}) - 1, 0)"
    return f"zip_with(slice({arr}, 1, {n}), slice({arr}, 2, {n}), {step})"


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside three-word windows found twice or more.

    Each window becomes one long, hash bits above and its place below, and the
    longs are sorted as primitives, so equal windows become neighbours. Neighbours
    with equal hash bits are compared word by word: a collision cannot add a
    repeat. Everything stays in the row; nothing is exploded or shuffled.
    """
    low = "(shiftleft(1L, _bits) - 1L)"

    def word(place: str, d: int) -> str:
        return f"_words[cast({place} as int) + {d}]"

    same = " AND ".join(
        f"{word(f'shiftright(e, _bits)', d)} = {word(f'(e & {low})', d)}" for d in range(3)
    )
    twins = (
        f"(x, y) -> if(shiftright(x, _bits) = shiftright(y, _bits), "
        f"shiftleft(x & {low}, _bits) | (y & {low}), -1L)"
    )
    return (
        rows.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
        .withColumn("_two", F.expr(_pairs("_hashes", "(a, b) -> xxhash64(a, b)")))
        .withColumn("_three", F.expr(
            "zip_with(slice(_two, 1, greatest(size(_two) - 1, 0)), "
            "slice(_hashes, 3, greatest(size(_hashes) - 2, 0)), (a, b) -> xxhash64(a, b))"
        ))
        .withColumn("_bits", F.expr("length(bin(size(_words)))"))
        .withColumn("_packed", F.expr(
            "sort_array(transform(_three, (h, i) -> shiftleft(shiftright(h, _bits), _bits) | i))"
        ))
        .withColumn("_equal", F.expr(f"filter({_pairs('_packed', twins)}, e -> e >= 0)"))
        .withColumn("_equal", F.expr(f"filter(_equal, e -> {same})"))
        .withColumn("_starts", F.expr(
            f"array_distinct(flatten(transform(_equal, e -> array(shiftright(e, _bits), e & {low}))))"
        ))
        .withColumn("n_repeat_words", F.expr(
            "cast(size(array_distinct(concat(_starts, transform(_starts, p -> p + 1L), "
            "transform(_starts, p -> p + 2L)))) as bigint)"
        ))
    )


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and every measurement, one row per input row."""
    rows = (
        docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .withColumn("_words", words(F.col("_text")))
        .withColumn("_bare", F.array_join("_words", ""))
        # A line without a word keeps nothing but white space.
        .withColumn("_lines", F.array_remove(F.split(
            F.regexp_replace("_text", r"(?md)^[ \t\x0B\x0C\r]+(?=\n|\z)", ""), "\n"), ""))
    )
    other = {
        "n_symbols": r"[^#*$%&|<>]+",
        "n_upper": r"\P{Lu}+",
        "n_marks": r"[^!?]+",
    }
    return _with_repeats(rows).select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length("_bare").cast("bigint").alias("word_chars"),
        *[
            F.length(F.regexp_replace("_bare", pattern, "")).cast("bigint").alias(name)
            for name, pattern in other.items()
        ],
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measurements plus ``fail_bits``: every rule evaluated once."""
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES)
    return measure(docs, text, keep).withColumn("fail_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: Policy, kept: str = "kept") -> DataFrame:
    """Mark the rows that fail none of the policy's rules."""
    return rows.withColumn(kept, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Per policy and rule: documents, failures, failures by this rule alone, and
    documents kept with and without the rule.

    The ledger is reduced map-side to its distinct bit patterns (at most two to
    the number of rules), so all policies together cost one aggregation.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("_docs"))
    wanted = F.array(*[
        F.struct(
            F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"),
            F.lit(1 << r.bit).alias("_bit"), F.lit(p.mask).alias("_mask"),
        )
        for p in policies for r in RULES if r.name in p.rules
    ])
    hit = F.col("fail_bits").bitwiseAND(F.col("_mask"))

    def docs(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_docs"))), F.lit(0))

    pairs = patterns.select("fail_bits", "_docs", F.inline(wanted))
    return pairs.groupBy("policy", "rule").agg(
        F.sum("_docs").alias("docs"),
        docs(F.col("fail_bits").bitwiseAND(F.col("_bit")) != 0).alias("failed"),
        docs(hit == F.col("_bit")).alias("failed_alone"),
        docs(hit == 0).alias("kept"),
        docs((hit == 0) | (hit == F.col("_bit"))).alias("kept_without_rule"),
    )


def kept_rows(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The input rows, all columns unchanged, that the policy keeps."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_rule_text"))
    marked = apply_policy(ledger(rows, "_rule_text", ("_row",)), policy, "_kept")
    # A filter would be pushed below the measurements and repeat them term by term.
    return marked.select(F.inline(F.expr("if(_kept, array(_row), slice(array(_row), 1, 0))")))
