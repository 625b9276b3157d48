"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector has its own codebook of ``k`` centroids; a pair of centroids
is a cell. A vector is stored in the cell of its nearest centroids and, as a
query, visits cells in the order of the summed distances of both halves. How many
it visits is set by calibration: for sample vectors and neighbours made exactly at
the threshold, the share of neighbours whose cell is visited must reach the target
recall. Candidates are then verified by cosine in double precision, so no link is
false. A link found from either end counts for both.

The codebooks are fitted on at most ``sample`` vectors (a documented bound); every
vector is indexed and queried. Equal vectors form one class and take part once,
with their number. A visit names the first centroid and a list of second ones, so a
vector is shuffled once per first centroid. Rows of one first centroid are cut into
blocks of at most ``BLOCK``; queries stream past a block, and a block writes link
counts and one edge per vector and batch, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite values link with
nothing; vectors of different lengths do not link with each other. Rows without an
id have no links and no component; rows that repeat an id are one vector each, tied
by the id. Labels and further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.llm.components import connected_components
from commentflow.session import stage

BLOCK = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros, of length one."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    n = np.diff(offsets)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], n)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * x @ centroids.T


def _k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        some = count > 0
        centroids[some] = sums[some] / count[some, None]
    return centroids


class Index:
    """Codebooks of both halves and the number of cells a query visits."""

    def __init__(self, vectors: np.ndarray, rows: int, cosine: float, recall: float):
        self.width = vectors.shape[1]
        self.half = max(1, self.width // 2)
        k = int(min(1024, len(vectors), max(1, np.sqrt(rows / 8))))
        self.books = [_k_means(vectors[:, : self.half], k), _k_means(vectors[:, self.half :], k)]
        self.visits = 1
        self.visits = self._calibrated(vectors, cosine, recall)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])]

    def _calibrated(self, vectors: np.ndarray, cosine: float, recall: float) -> int:
        rng = np.random.default_rng(3)
        x = vectors[rng.permutation(len(vectors))[:500]]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(1 - cosine**2) * noise
        a, b = self.distances(x)
        i, j = (d.argmin(axis=1) for d in self.distances(y))
        at = np.arange(len(x))
        reach = a[at, i] + b[at, j]
        b = np.sort(b, axis=1)
        rank = np.array([np.searchsorted(b[r], reach[r] - a[r]).sum() for r in at.tolist()])
        return int(min(a.shape[1] * b.shape[1], np.quantile(rank, recall) + 1))

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second centroids of the cells each query visits, nearest first:
        among the n smallest sums, the (i, j)-th in sorted order has (i+1)(j+1) <= n."""
        a, b = self.distances(x)
        k, n = a.shape[1], self.visits
        order = [np.argsort(d, axis=1, kind="stable") for d in (a, b)]
        first, second = (
            np.take_along_axis(d, o, axis=1) for d, o in zip((a, b), order, strict=True)
        )
        i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        near = (i + 1) * (j + 1) <= n
        i, j = i[near], j[near]
        best = np.argsort(first[:, i] + second[:, j], axis=1, kind="stable")[:, :n]
        return np.take_along_axis(order[0], i[best], axis=1), np.take_along_axis(order[1], j[best], axis=1)

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(axis=1), b.argmin(axis=1)


def _dealt(reps: DataFrame, shared) -> DataFrame:
    """Index rows (kind 0, with the cells their own query visits) and query rows."""
    def run(batches):
        index = shared.value
        k = len(index.books[0])
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = _matrix(batch.column("vector"), index.width)
                i, j = index.cell(x)
                first, second = index.visited(x)
                cells = first * k + second
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel().astype(np.int32))
                )
                yield _rows(batch, np.arange(len(x)), i, np.zeros(len(x), int), i * k + j, lists)
                order = np.argsort(first, axis=1, kind="stable")
                first, second = (np.take_along_axis(v, order, axis=1) for v in (first, second))
                new = np.ones(first.shape, bool)
                new[:, 1:] = first[:, 1:] != first[:, :-1]
                cut = np.flatnonzero(new.ravel())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(cut, second.size).astype(np.int32)), pa.array(second.ravel().astype(np.int32))
                )
                row = cut // first.shape[1]
                yield _rows(batch, row, first.ravel()[cut], np.ones(len(row), int), (i * k + j)[row], lists)

    element = reps.schema["vector"].dataType.simpleString()
    return reps.select("rep", "n", "vector").mapInArrow(
        run, f"rep long, n long, vector {element}, first int, kind int, cell int, cells array<int>"
    )


def _rows(batch, row, first, kind, cell, lists) -> pa.RecordBatch:
    columns = [batch.column(c).take(pa.array(row)) for c in ("rep", "n", "vector")]
    numbers = [pa.array(v.astype(np.int32)) for v in (first, kind, cell)]
    return pa.RecordBatch.from_arrays([*columns, *numbers, lists], ["rep", "n", "vector", "first", "kind", "cell", "cells"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    edge = label != np.arange(len(nodes))
    return nodes[edge], nodes[label[edge]]


def _verified(dealt: DataFrame, shared, cosine: float) -> DataFrame:
    """Rows (id, other, links): link counts per vector, and edges of components."""
    def run(batches):
        index = shared.value
        k = len(index.books[0])
        key, parts, block = None, [], None
        for whole in batches:
            ids = np.stack([whole.column(c).to_numpy() for c in ("first", "block", "kind")])
            cuts = np.flatnonzero(np.any(np.diff(ids, axis=1) != 0, axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                now, kind = tuple(ids[:2, a]), ids[2, a]
                if now != key:
                    key, parts, block = now, [], None
                if kind == 0:
                    parts.append(batch)
                    continue
                if not parts:
                    continue
                if block is None:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    order = np.argsort(table["cell"].to_numpy(), kind="stable")
                    table = table.take(pa.array(order)).combine_chunks()
                    cell = table["cell"].to_numpy()
                    block = (
                        table["rep"].to_numpy(), table["n"].to_numpy(), _matrix(table["vector"].chunk(0), index.width),
                        cell % k, table["cells"].chunk(0).flatten().to_numpy().reshape(len(cell), -1),
                        table["size"].to_numpy(),
                    )
                yield from compare(batch, block, index)

    def compare(batch, block, index):
        rep, n, y, second, visits, length = block
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x = _matrix(part.column("vector"), index.width)
            own, count, cell, size = (part.column(c).to_numpy() for c in ("rep", "n", "cell", "size"))
            lists = part.column("cells")
            offsets = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(x)), np.diff(offsets))
            wanted = lists.flatten().to_numpy()
            order = np.argsort(wanted, kind="stable")
            wanted, row = wanted[order], row[order]
            cells, start = np.unique(second, return_index=True)
            stop = np.append(start[1:], len(second))
            ask, until = np.searchsorted(wanted, cells), np.searchsorted(wanted, cells, side="right")
            found = []
            for s, e, q, r in zip(start.tolist(), stop.tolist(), ask.tolist(), until.tolist(), strict=True):
                if q == r:
                    continue
                rows = row[q:r]
                i, j = np.nonzero(x[rows] @ y[s:e].T >= cosine)
                if len(i):
                    found.append((rows[i], j + s))
            if not found:
                continue
            i, j = (np.concatenate(v) for v in zip(*found, strict=True))
            real = (own[i] != rep[j]) & (size[i] == length[j])
            i, j = i[real], j[real]
            # The link is also found from the other end if that query visits this cell.
            both = np.concatenate([
                (visits[j[c : c + 4096]] == cell[i[c : c + 4096], None]).any(axis=1) for c in range(0, len(i), 4096)
            ] or [np.zeros(0, bool)])
            who = np.concatenate([own[i], rep[j[~both]]])
            many = np.concatenate([n[j], count[i[~both]]])
            ids, place = np.unique(who, return_inverse=True)
            total = np.bincount(place, weights=many, minlength=len(ids)).astype(np.int64)
            a, b = _forest(own[i], rep[j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, a])),
                    pa.array(np.concatenate([ids, b])),
                    pa.array(np.concatenate([total, np.zeros(len(a), np.int64)])),
                ],
                ["id", "other", "links"],
            )

    return dealt.repartition("first", "block").sortWithinPartitions("first", "block", "kind").mapInArrow(
        run, "id long, other long, links long"
    )


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.9,
    recall: float = 0.95, sample: int = 20_000,
) -> DataFrame:
    """Per input row: the id, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    good = F.coalesce(
        (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists("vector", lambda v: v != 0),
        F.lit(False),
    ) & F.col("id").isNotNull()
    valid = rows.filter(good)
    reps = stage(
        valid.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("size", F.size("vector")),
        "vectors",
    )
    member = stage(valid.join(reps.select("vector", "rep", "n"), "vector").select("id", "rep", "n"), "members")
    count, width = reps.agg(F.count(F.lit(1)), F.max("size")).first()
    if not count:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
            F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"),
        )
    chosen = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    chosen = chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen
    index = Index(_matrix(chosen, width), count, cosine, recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks of at most 1024 centroids
    dealt = stage(_dealt(reps, shared).join(reps.select("rep", "size"), "rep"), "dealt")
    blocks = dealt.filter("kind = 0").groupBy("first").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    spread = dealt.join(blocks, "first").withColumn(
        "block",
        F.explode(F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("rep"), "blocks").cast("int")))
                  .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))),
    )
    found = stage(_verified(spread, shared, cosine), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    tied = member.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = found.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    component = connected_components(edges.union(tied)).withColumnRenamed("node", "id")
    linked = member.join(links, "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    ).groupBy("id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("id", good.alias("good")).join(linked, "id", "left").join(component, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("good"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
