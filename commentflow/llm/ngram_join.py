"""Jaccard self-join of documents on word shingles, by vertical partitioning.

The order of shingle hashes is cut into fragments. Small fragments name the
candidates: two sets at or above the threshold are equal in at least one of the
named fragments (``shingles.fragment_keys``), whatever the data, so no pair is
lost. Overlaps of candidates are then counted per fragment of equal hash ranges
and summed per pair.

Equal sets form one class and take part once. Documents that share a name are
first paired with the class of the smallest id there; after those links are
known, only documents of different components are compared, in blocks of bounded
size, and parity sketches (a proven bound, not an estimate) drop dissimilar pairs
before any is written. Groups are so neither collected nor expanded into pairs.

Rows without an id have a set size and no component. A null or blank text has an
empty set and links with nothing. Rows that repeat an id are one document. Other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from commentflow.llm import shingles
from commentflow.llm.batches import slices
from commentflow.llm.components import connected_components
from commentflow.session import stage

BLOCK = 1024  # rows of one name compared with as many others in one step
FRAGMENT_BITS = 4
SLICE = 1 << 20  # bytes of text shingled at a time
SEEN = 1 << 17  # sets whose equals a task skips


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc, n_shingles, two hashes of the whole set, and its sketch."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                h, at = shingles.shingle_sets(batch.column("text"))
                n = np.diff(at)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                        for x in (h, shingles.mix(h))]
                sig = [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]
                odd = [shingles.sketch(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(n), *sig, pa.array(odd, pa.binary())],
                    ["doc", "n_shingles", "sig_a", "sig_b", "sketch"],
                )

    return _texts(docs, id_col, text).mapInArrow(
        run, "doc long, n_shingles long, sig_a long, sig_b long, sketch binary"
    )


def _names(docs: DataFrame, id_col: str, text: str, percent: int) -> DataFrame:
    """Rows (name, doc): the named fragments, once per task for equal sets."""
    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                h, at = shingles.shingle_sets(batch.column("text"))
                key, owner = shingles.fragment_keys(h, at, percent)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(h), dtype=np.uint64)])
                fresh = np.zeros(len(at) - 1, bool)
                for i, s in enumerate((total[at[1:]] - total[at[:-1]]).tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                    if len(seen) > SEEN:
                        seen.clear()  # only saves work: equal sets meet again later
                use = fresh[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[use].view(np.int64)), batch.column("doc").take(pa.array(owner[use]))],
                    ["name", "doc"],
                )

    return _texts(docs, id_col, text).filter("doc IS NOT NULL").mapInArrow(run, "name long, doc long")


def _segments(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted documents, one row per fragment of equal hash ranges."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                h, at = shingles.shingle_sets(batch.column("text"))
                part = (h >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int32)
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                cut = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
                offsets = pa.array(np.append(cut, len(h)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(pa.array(owner[cut])),
                        pa.array(np.diff(at)[owner[cut]]),
                        pa.array(part[cut]),
                        pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))),
                    ],
                    ["doc", "n", "fragment", "hashes"],
                )

    return _texts(docs, id_col, text).join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(
        run, "doc long, n long, fragment int, hashes array<long>"
    )


def _verified(docs: DataFrame, id_col: str, text: str, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed partial overlaps reach the threshold."""
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    parts = stage(_segments(docs, id_col, text, wanted), "segments")
    left = parts.select(F.col("doc").alias("a"), F.col("n").alias("na"), "fragment", F.col("hashes").alias("ha"))
    right = parts.select(F.col("doc").alias("b"), F.col("n").alias("nb"), "fragment", F.col("hashes").alias("hb"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("bigint").alias("part")
    )
    both = F.sum("part")
    return partial.groupBy("a", "b", "na", "nb").agg(both.alias("both")).filter(
        F.expr(f"100 * both >= {percent} * (na + nb - both)")
    ).select("a", "b")


def _close(lists: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components that share a name, compared in blocks."""
    columns = ("name", "lo", "hi", "block", "doc", "component", "n_shingles")

    def whole_groups(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            if not table.num_rows:
                continue
            ids = np.stack([table.column(c).to_numpy() for c in columns[:3]])
            cut = np.flatnonzero(np.any(ids[:, 1:] != ids[:, :-1], axis=0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            if last:
                yield table.slice(0, last).combine_chunks()
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield rest.combine_chunks()

    def run(batches):
        for table in whole_groups(batches):
            name, lo, hi, block, doc, comp, n = (table.column(c).to_numpy() for c in columns)
            new = (np.diff(name) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
            ends = np.append(np.flatnonzero(new) + 1, len(name))
            after = ends[np.searchsorted(ends, np.arange(len(name)), side="right")] - np.arange(len(name)) - 1
            odd = table.column("sketch").chunk(0)
            step = np.cumsum(after) >> 20  # about a million pairs at a time
            for k in np.unique(step):
                row = np.flatnonzero(step == k)
                m = after[row]
                i = np.repeat(row, m)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
                ok = (comp[i] != comp[j]) & ((block[i] != block[j]) | (lo[i] == hi[i]))
                ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                near = ~shingles.far_apart(odd, i, j, n, percent)
                ends_of = np.unique(np.sort(np.stack([doc[i[near]], doc[j[near]]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends_of[0]), pa.array(ends_of[1])], ["a", "b"])

    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    spread = (
        lists.withColumn("block", F.pmod(F.xxhash64("doc"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
    )
    dealt = spread.repartition("name", "lo", "hi").sortWithinPartitions("name", "lo", "hi")
    return dealt.select("name", "lo", "hi", "block", "doc", "component", "n_shingles", "sketch").mapInArrow(
        run, "a long, b long"
    ).distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80):
    """Membership and links: a table (doc, n_shingles, class_id) with one row per
    input row, and links (a, b) between classes that together join every pair of
    classes which the threshold links, directly or through other links."""
    rows = stage(signatures(docs, id_col, text), "signatures")
    known = rows.filter("doc IS NOT NULL AND n_shingles > 0")
    same = ["n_shingles", "sig_a", "sig_b"]
    classes = known.groupBy(*same).agg(F.min("doc").alias("class_id"), F.first("sketch").alias("sketch"))
    member = stage(known.select("doc", *same).join(classes.drop("sketch"), same), "members")
    reps = stage(classes.select(F.col("class_id").alias("doc"), "n_shingles", "sketch"), "classes")

    named = _names(docs, id_col, text, percent)
    shared = named.withColumn("rows", F.count(F.lit(1)).over(W.partitionBy("name"))).filter("rows > 1")
    by_class = (
        stage(shared.select("name", "doc"), "shared").join(member, "doc")
        .select("name", F.col("class_id").alias("doc"), "n_shingles").distinct()
    )
    whole = W.partitionBy("name")
    lists = stage(
        by_class.withColumn("rows", F.count(F.lit(1)).over(whole))
        .withColumn("first", F.min(F.struct("doc", "n_shingles")).over(whole)).filter("rows > 1"),
        "lists",
    )
    near = F.expr(
        f"100 * least(n_shingles, first.n_shingles) >= {percent} * greatest(n_shingles, first.n_shingles)"
    )
    stars = lists.filter((F.col("doc") != F.col("first.doc")) & near).select(
        F.col("first.doc").alias("a"), F.col("doc").alias("b")
    ).distinct()

    def apart(batches):
        for batch in batches:
            m = np.arange(batch.num_rows)
            odd = pa.concat_arrays([batch.column("sa"), batch.column("sb")])
            sizes = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            near = pa.array(~shingles.far_apart(odd, m, m + len(m), sizes, percent))
            yield batch.select(["a", "b"]).filter(near)

    one = reps.select(F.col("doc").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("doc").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    stars = stage(
        stars.join(one, "a").join(two, "b").mapInArrow(apart, "a long, b long"),
        "stars",
    )
    first = stage(_verified(docs, id_col, text, stars, percent), "links")
    # A class of copies is one node; rows that repeat an id tie their classes together.
    tied = member.select(F.col("doc").alias("a"), F.col("class_id").alias("b")).filter("a <> b")
    found = connected_components(first.union(tied))
    open_ = (
        lists.filter("rows > 2").drop("first")
        .join(found.withColumnRenamed("node", "doc"), "doc", "left")
        .withColumn("component", F.coalesce("component", "doc"))
        .withColumn("_few", F.min("component").over(whole)).withColumn("_many", F.max("component").over(whole))
        .filter("_few < _many").drop("_few", "_many")
        .join(reps.select("doc", "sketch"), "doc")
    )
    more = _verified(docs, id_col, text, stage(_close(open_, percent), "close"), percent)
    all_links = stage(first.union(more), "links")
    return rows.select("doc", "n_shingles"), tied, all_links


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per input row: the id, ``n_shingles`` and ``component_id``, the smallest id
    reachable by links (its own without any)."""
    rows, tied, found = links(docs, id_col, text, percent)
    component = connected_components(found.union(tied)).withColumnRenamed("node", "doc")
    return rows.join(component, "doc", "left").select(
        F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id")
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Of every component the document with the smallest id, all columns unchanged.

    Rows without an id stay. Of rows that repeat an id one stays, the first by text.
    """
    kept = join(docs, id_col, text, percent).filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    known = docs.join(kept, id_col, "left_semi")
    again = known.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text).isNull(), F.col(text))).alias("_row"))
    return again.select("_row.*").unionByName(docs.filter(F.col(id_col).isNull()))
