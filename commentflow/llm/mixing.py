"""Mixing sources to target weights by entropy balancing.

A document of ``size`` words gets the rate ``min(3, exp(l * size / mean size))``
of the weights nearest to one in relative entropy whose words add up to the
source's target; ``l`` is the source's multiplier. The dual is convex and splits by source; Newton steps,
kept inside a bracket, solve it over the table of distinct (source, size), which
Spark aggregates once. Documents of one source and size share a rate, so copies are
rounded for those groups: systematically along the sizes (running sums of the
fractional parts), then, from the largest size down, documents that fit into what a
source still misses take or give back copies between the floor and the ceiling
of their rate. No random numbers; reruns agree.

Null texts and texts without words have size 0 and rate 1 and are kept once. A
null source is a source of its own, last in order. A negative or null weight is
refused. Rows that repeat are documents of their own, ordered by place-free
columns only, so equal rows may swap their copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentflow.llm.words import word_count
from commentflow.operators.ordered import global_rank, group_rank, running_sums
from commentflow.session import stage

MOST = 3  # copies of a document, and words of a source's target over its own
UNIT = 1 << 30  # a rate inside the Newton sums
MICRO = 1_000_000  # rates are rounded in millionths, so that sums are exact
# Points of a ladder: the first below and above 0 (shares of the largest multiplier),
# later in widths of the last Newton step.
DOWN = (1000, 300, 100, 30, 10, 5, 3, 2, 1.4, 1, 0.7, 0.4, 0.2, 0.1)
UP = (0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7, 1)
AROUND = (1e-6, 1e-4, 1e-3, 1e-2, 0.1, 0.3, 1)


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0) -> DataFrame:
    """Add ``target`` to a table (source, source_size): one row per source.

    Weights repeat over the sources in code-point order, null last. A target
    stops at three times its source's size; what is above goes to the others by
    weight. Water-filling finds the level in closed form: sources sorted by the
    share of their cap in their weight fill up in that order.
    """
    if not weights or any(w is None or w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    named = sizes.withColumn("_none", F.col("source").isNull())
    ranked = global_rank(named, [F.col("_none"), F.col("source")], "_rank")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn(
        "_weight", F.element_at(table, (F.col("_rank") % len(weights) + 1).cast("int"))
    ).withColumn("_cap", (MOST * F.col("source_size")).cast("double"))
    order = [(F.col("_cap") / F.col("_weight")), F.col("_none"), F.col("source")]
    summed = running_sums(
        weighed.withColumn("_own", F.col("source_size").cast("double")), order,
        {"_caps": "_cap", "_weights": "_weight", "_sizes": "_own"},
        {"_all_weights": "_weights", "_all_sizes": "_sizes"},
    )
    # Level if this source and all before it are at their cap: what remains, per weight.
    filled = summed.withColumn("_level_before", (
        (F.col("_all_sizes") * share - (F.col("_caps") - F.col("_cap")))
        / (F.col("_all_weights") - (F.col("_weights") - F.col("_weight")))
    ))
    # That level rises while sources fill up and falls after, so its largest value holds.
    level = filled.agg(F.max("_level_before")).first()[0]
    return filled.select(
        "source", "source_size", F.least("_cap", F.lit(level or 0.0) * F.col("_weight")).alias("target")
    )


def _rate(multiplier: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * F.col("_x"), F.lit(50.0))))


def _ladder(first: bool) -> Column:
    """Multipliers that one aggregation tries for a source: the Newton step, points at
    growing distance around it, and points that cut the bracket."""
    inside = "p -> p > _low AND p < _high"
    if first:
        below = ", ".join(f"-{d}D" for d in DOWN)
        above = ", ".join(f"_high * {f}D" for f in UP)
        return F.expr(f"array({below}, 0D, {above})")
    around = ", ".join(f"l + {d}D * _width, l - {d}D * _width" for d in AROUND)
    cuts = ", ".join(f"_low + {f}D * (_high - _low)" for f in (0.25, 0.5, 0.75))
    return F.expr(f"if(_done, array(l), array_distinct(filter(array(l, {around}, {cuts}), {inside})))")


def multipliers(groups: DataFrame, wanted: DataFrame, steps: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """The dual multiplier of every source, by Newton steps inside a bracket.

    ``groups`` has one row per (source, size) with its number of documents ``n``. A
    step is one aggregation that tries a ladder of multipliers per source at once, so
    few steps are needed (four to six as a rule); the Newton step is taken on the
    logarithm of the words, which is nearly linear. The driver sees only whether
    sources are left. A target at the cap asks for the largest multiplier: every rate
    is then three.
    """
    means = groups.groupBy("source").agg((F.sum(F.col("_size") * F.col("n")) / F.sum("n")).alias("_mean"))
    base = stage(
        groups.join(means, groups["source"].eqNullSafe(means["source"])).drop(means["source"])
        .withColumn("_x", F.col("_size") / F.col("_mean")),
        "mix-groups",
    )
    # exp(l x) <= 3 for every x when l = 0 and all >= 3 when l = ln 3 / smallest x.
    ends = base.groupBy("source").agg(F.min("_x").alias("_least"))
    state = ends.join(wanted, ends["source"].eqNullSafe(wanted["source"])).drop(wanted["source"]).select(
        "source", "target", F.lit(-1e6).alias("_low"), (F.log(F.lit(3.0)) / F.col("_least")).alias("_high")
    )
    for step in range(steps):
        tried = state.select("source", "target", "_low", "_high", F.explode(_ladder(step == 0)).alias("p"))
        rate = _rate(F.col("p"))
        # Whole numbers, so that sums do not depend on the order of the rows.
        words = (F.col("_size") * F.col("n")).cast("decimal(38,0)") * F.round(rate * UNIT).cast("bigint")
        slope = F.when(rate < MOST, words * F.col("_size")).otherwise(F.lit(0).cast("decimal(38,0)"))
        sums = (
            base.join(tried, base["source"].eqNullSafe(tried["source"])).drop(base["source"])
            .groupBy("source", "target", "_low", "_high", "p")
            .agg(
                (F.sum(words).cast("double") / UNIT).alias("_words"),
                (F.sum(slope).cast("double") / UNIT / F.first("_mean")).alias("_slope"),
            )
            .withColumn("_miss", F.col("_words") - F.col("target"))
        )
        best = sums.groupBy("source", "target").agg(
            F.greatest(F.max("_low"), F.max(F.when(F.col("_miss") < 0, F.col("p")))).alias("_low"),
            F.least(F.min("_high"), F.min(F.when(F.col("_miss") >= 0, F.col("p")))).alias("_high"),
            F.min(F.struct(F.abs("_miss").alias("miss"), "p", "_words", "_slope")).alias("at"),
        )
        newton = F.expr("at.p - try_divide(at._words, at._slope) * ln(try_divide(at._words, target))")
        middle = (F.col("_low") + F.col("_high")) / 2
        done = (F.col("at.miss") <= tolerance * F.col("target")) | (
            F.col("_high") - F.col("_low") <= 1e-12 * (1 + F.abs("at.p"))
        )
        state = stage(
            best.withColumn("_newton", newton).withColumn("_done", done)
            .withColumn("_inside", F.coalesce((F.col("_newton") > F.col("_low")) & (F.col("_newton") < F.col("_high")), F.lit(False)))
            .select(
                "source", "target", "_low", "_high", "_done",
                F.when(F.col("_done"), F.col("at.p")).when(F.col("_inside"), F.col("_newton")).otherwise(middle).alias("l"),
                F.when(F.col("_inside"), F.abs(F.col("_newton") - F.col("at.p"))).otherwise((F.col("_high") - F.col("_low")) / 4).alias("_width"),
            ),
            "mix-state",
        )
        if state.filter("NOT _done").isEmpty():
            break
    return state.select("source", "l")


def _rounded(rated: DataFrame) -> DataFrame:
    """Add ``_copies``: the whole copies of each (source, size) group together."""
    order = [F.col("source").isNull(), F.col("source"), F.col("_size")]
    parts = rated.withColumn("_part", F.col("n") * (F.col("_micro") % MICRO))
    half = MICRO // 2
    now = stage(running_sums(parts, order, {"_sum": "_part"}).withColumn("_copies", F.expr(
        f"n * (_micro div {MICRO}) + (_sum + {half}) div {MICRO} - (_sum - _part + {half}) div {MICRO}"
    )), "mix-rounded")
    missing = now.groupBy("source").agg(
        F.round(F.first("target") - F.sum(F.col("_copies") * F.col("_size"))).cast("bigint").alias("_missing")
    )
    open_ = now.join(missing, now["source"].eqNullSafe(missing["source"])).drop(missing["source"]).withColumn(
        "_can", F.expr(
            f"if(_missing > 0, n * ((_micro + {MICRO} - 1) div {MICRO}) - _copies, _copies - n * (_micro div {MICRO}))"
        )
    )
    # Of the sizes that agree in their first four bits the largest that can change; then these
    # (at most 512 a source), largest first, take as many copies as fit into what is left.
    offers = (
        open_.filter("_can > 0 AND _size > 0 AND _size <= abs(_missing)")
        .groupBy("source", "_missing", F.length(F.bin("_size")).alias("_bits"), F.substring(F.bin("_size"), 1, 4).alias("_head"))
        .agg(F.max(F.struct("_size", "_can")).alias("_offer"))
        .groupBy("source", "_missing")
        .agg(F.reverse(F.array_sort(F.collect_list("_offer"))).alias("_offers"))
    )
    took = F.expr("""inline(aggregate(_offers,
        named_struct('left', abs(_missing), 'took', cast(array() AS array<struct<s: bigint, k: bigint>>)),
        (a, o) -> named_struct('left', a.left - least(o._can, a.left div o._size) * o._size,
            'took', array_append(a.took, named_struct('s', o._size, 'k', least(o._can, a.left div o._size)))),
        a -> a.took))""")
    changes = offers.select(F.col("source").alias("_source"), F.sign("_missing").cast("bigint").alias("_sign"), took)
    same = now["source"].eqNullSafe(changes["_source"]) & (now["_size"] == changes["s"])
    changed = now.join(changes, same, "left").withColumn(
        "_copies", F.col("_copies") + F.coalesce(F.col("_sign") * F.col("k"), F.lit(0))
    )
    return stage(changed.select("source", "_size", "n", "source_size", "target", "_rate", "_copies"), "mix-rounded")


def mix(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0, text: str = "text", source: str = "source",
) -> DataFrame:
    """Per input row: ``keep``, size, source_size, target, rate, copies and taken."""
    sized = stage(
        docs.select(
            *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
            F.col(source).alias("source"), word_count(F.col(text)).alias("_size"),
            F.xxhash64(source, text, *keep).alias("_tie"),
        ),
        "mix-sizes",
    )
    groups = stage(sized.groupBy("source", "_size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    by_source = groups.groupBy("source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    goal = stage(targets(by_source, weights, share), "mix-targets")
    solved = multipliers(groups.filter("_size > 0"), goal.filter("source_size > 0"))
    means = groups.filter("_size > 0").groupBy("source").agg(
        (F.sum(F.col("_size") * F.col("n")) / F.sum("n")).alias("_mean")
    )
    per_source = goal
    for other in (solved, means):
        per_source = per_source.join(other, per_source["source"].eqNullSafe(other["source"]), "left").drop(other["source"])
    # Few sources are broadcast by Spark's own size check; many are joined by key.
    rated = (
        groups.join(per_source, groups["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
        .withColumn("_x", F.col("_size") / F.col("_mean"))
        .withColumn("_rate", F.when(F.col("_size") == 0, 1.0)
                    .when(F.col("target") >= MOST * F.col("source_size"), float(MOST))
                    .otherwise(_rate(F.col("l"))))
        .select("source", "_size", "n", "source_size", "target", "_rate",
                F.round(F.col("_rate") * MICRO).cast("bigint").alias("_micro"))
    )
    shared = _rounded(rated)
    ranked = group_rank(sized, ["source", "_size"], [F.col("_tie")], "_place")
    same = ranked["source"].eqNullSafe(shared["source"]) & (ranked["_size"] == shared["_size"])
    rows = ranked.join(shared, same).drop(shared["source"]).drop(shared["_size"])
    copies = F.expr("_copies div n + if(_place < _copies % n, 1, 0)").cast("bigint")
    return rows.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_size").alias("size"), "source_size", "target", F.col("_rate").alias("rate"),
        copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix itself: input rows as often as ``mix`` has copies of them.

    Equal rows (id, source and text) are one row whose copies add up.
    """
    tie = F.xxhash64(source, text, id_col)
    keyed = docs.withColumn("_mix_tie", tie)
    copies = mix(keyed, (id_col, "_mix_tie"), weights, share, text, source).groupBy(
        F.col(id_col).alias("_mix_id"), F.col("_mix_tie").alias("_mix_key")
    ).agg(F.sum("copies").alias("_mix_copies")).filter("_mix_copies > 0")
    same = keyed[id_col].eqNullSafe(copies["_mix_id"]) & (keyed["_mix_tie"] == copies["_mix_key"])
    return (
        keyed.dropDuplicates([id_col, "_mix_tie"]).join(copies, same)
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select(*docs.columns)
    )
