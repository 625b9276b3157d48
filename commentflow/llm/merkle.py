"""Merkle manifest of a dataset, with a proof per row.

Every row is a leaf: the SHA-256 of its fields, each as ``-`` for null or as UTF-8
byte count, ``:`` and value. Inside a group the leaves stand in id order; while
several nodes remain, every eight in a row become one, the hash of their hexadecimal
digests. The groups' roots, in the order of the group values (null first), are put
together in the same way to the root of the dataset.

The tree is cut into superblocks of ``8 ** LEVELS`` nodes. Going up, a superblock is
reduced to the node above it, layer by layer, until one node is left per group.
Going down, the nodes of a superblock are cogrouped with the one outer node that its
place in the tree requires (the path of siblings above it). That call finishes the
reduction inside the superblock and joins and folds every proof, so no task holds more
than one superblock, however large a group is. Rows travel as ids and digests only.

Null ids come first; rows that repeat an id are ordered by their leaf, so equal rows
are neighbours with proofs of their own. A null or empty text is a field like any
other, and a long one is hashed whole. A null group value is a group. An empty table
gives no rows. Only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.operators.ordered import global_rank, running_sums
from commentflow.session import stage

WIDTH = 8
LEVELS = 3  # of a superblock
_NODE = "tree long, pos long, n long, hash string"
_PATH = "tree long, pos long, n long, hash string, path string, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Sequence[bytes | None]) -> str:
    whole = hashlib.sha256()
    for value in fields:
        whole.update(b"-" if value is None else b"%d:" % len(value) + value)
    return whole.hexdigest()


def _depth(n: int) -> int:
    """Rounds of reduction until one of n nodes is left."""
    rounds = 0
    while n > 1:
        n, rounds = -(-n // WIDTH), rounds + 1
    return rounds


def _reduced(hashes: list[str], n: int) -> list[list[str]]:
    """The levels inside a superblock of a layer of n nodes, its own nodes first."""
    levels = [hashes]
    for _ in range(min(LEVELS, _depth(n))):
        last = levels[-1]
        levels.append([digest(*last[k : k + WIDTH]) for k in range(0, len(last), WIDTH)])
    return levels


def _hashed(docs: DataFrame, id_col: str, group_col: str, fields: Sequence[str], text: str, altered: Column | None, shown: Column | None) -> DataFrame:
    names = [f"f{i}" for i in range(len(fields))]
    at = list(fields).index(text)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"),
        *[F.col(c).cast("string").cast("binary").alias(n) for c, n in zip(fields, names, strict=True)],
        (F.lit(None) if altered is None else F.when(altered, shown)).cast("binary").alias("shown"),
        (F.lit(False) if altered is None else F.coalesce(altered, F.lit(False))).alias("altered"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, seen = [], []
            columns = (batch.column(c) for c in (*names, "shown", "altered"))
            for *row, other, changed in zip(*columns, strict=True):
                values = [v.as_py() for v in row]
                made.append(leaf(values))
                if changed.as_py():
                    values[at] = other.as_py()
                    seen.append(leaf(values))
                else:
                    seen.append(made[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("group"), pa.array(made, pa.string()), pa.array(seen, pa.string())],
                ["id", "group", "leaf", "shown_leaf"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"id {kinds['id']}, group {kinds['group']}, leaf string, shown_leaf string")


def _up(nodes: DataFrame) -> DataFrame:
    """The nodes above the superblocks of a layer."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        n, first = int(part["n"].iloc[0]), int(part["pos"].iloc[0])
        above = WIDTH ** min(LEVELS, _depth(n))
        top = _reduced(part["hash"].tolist(), n)[-1][0]
        row = int(part["tree"].iloc[0]), first // WIDTH**LEVELS, -(-n // above), top
        return pd.DataFrame([row], columns=["tree", "pos", "n", "hash"])

    return nodes.select("tree", "pos", "n", "hash", _block()).groupBy("tree", "block").applyInPandas(run, _NODE)


def _block() -> Column:
    return F.floor(F.col("pos") / WIDTH**LEVELS).alias("block")


def _layers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The given nodes and the layers above, up to one node per tree."""
    out = [nodes]
    while most > 1:
        out.append(stage(_up(out[-1]), "merkle_up"))
        most = -(-most // WIDTH**LEVELS)
    return out


def _siblings(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For every node that is hashed further: the digests left and right of it in its run."""
    out = []
    for row in levels[:-1]:
        pairs = []
        for k in range(0, len(row), WIDTH):
            run = row[k : k + WIDTH]
            pairs += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
        out.append(pairs)
    return out


def _down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The path above every node of a layer: ``left,right;`` per level, from below."""
    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        around = _siblings(_reduced(part["hash"].tolist(), int(part["n"].iloc[0])))
        rest, subroot, root = above[["path", "subroot", "root"]].iloc[0]
        paths = [
            "".join("{},{};".format(*pairs[i // WIDTH**k]) for k, pairs in enumerate(around)) + rest
            for i in range(len(part))
        ]
        return part[["tree", "pos", "n", "hash"]].assign(path=paths, subroot=subroot, root=root)

    return _cogrouped(nodes.select("tree", "pos", "n", "hash", _block()), outer).applyInPandas(run, _PATH)


def _cogrouped(nodes: DataFrame, outer: DataFrame):
    above = outer.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))


def _proved(leaves: DataFrame, outer: DataFrame, kind: str) -> DataFrame:
    """Digest and folding of every leaf's proof."""
    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        around = _siblings(_reduced(part["hash"].tolist(), int(part["n"].iloc[0])))
        rest, subroot, root = above[["path", "subroot", "root"]].iloc[0]
        higher = [tuple(level.split(",")) for level in rest.split(";")[:-1]]
        proofs, folded = [], []
        for i, now in enumerate(part["shown_leaf"]):
            path = [pairs[i // WIDTH**k] for k, pairs in enumerate(around)] + higher
            proofs.append(digest(*[side for level in path for side in level]))
            for left, right in path:
                now = digest(left, now, right)
            folded.append(now)
        return pd.DataFrame({
            "id": part["id"], "leaf": part["hash"], "subroot": subroot, "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _cogrouped(leaves, outer).applyInPandas(run, schema)


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    text: str = "text", altered: Column | None = None, shown: Column | None = None,
) -> DataFrame:
    """One row per row: id, ``leaf``, ``subroot`` (of its group), ``root``, ``proof_sha256``
    (the hash of the leaf's siblings up to the root), ``folded_root`` and ``verified``.

    Where ``altered`` holds, the row is checked as if ``text`` were ``shown``: the
    folded root starts from that leaf and uses the siblings of the manifest.
    """
    leaves = stage(_hashed(docs, id_col, group_col, fields, text, altered, shown), "merkle_leaves")
    # Ids travel as text: pandas has no whole numbers with nulls.
    kind = leaves.schema["id"].dataType.simpleString()
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("shown_leaf")]
    groups = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    groups = running_sums(groups, order[:1], {"upto": "n", "no": "one"}).select(
        F.col("group").alias("_group"), "n", (F.col("upto") - F.col("n")).alias("first"), (F.col("no") - 1).alias("tree")
    )
    groups = stage(groups, "merkle_groups")
    size = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    ranked = global_rank(leaves, order, "rank").join(groups, F.col("group").eqNullSafe(F.col("_group")))
    nodes = stage(ranked.select(
        "tree", (F.col("rank") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("hash"),
        F.col("id").cast("string").alias("id"), "shown_leaf",
    ), "merkle_nodes")

    inner = _layers(nodes, size[0])
    subroots = inner[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size[1]).cast("long").alias("n"), "hash")
    outer = _layers(subroots, size[1])
    paths = outer[-1].select("tree", "pos", "n", "hash", F.lit("").alias("path"), "hash", F.col("hash").alias("root"))
    paths = paths.toDF("tree", "pos", "n", "hash", "path", "subroot", "root")
    for layer in reversed(outer[:-1]):
        paths = _down(layer, paths)
    paths = stage(paths, "merkle_paths").select(
        F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root"
    )
    for layer in reversed(inner[1:-1]):
        paths = stage(_down(layer, paths), "merkle_paths")
    leaves = nodes.select("tree", "pos", "n", "hash", "id", "shown_leaf", _block())
    done = _proved(leaves, paths, "string")
    return done.select(F.col("id").cast(kind).alias(id_col), *done.columns[1:])
