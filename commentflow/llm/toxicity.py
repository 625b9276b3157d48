"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text (runs of letters, digits and non-ASCII
bytes, lower case) and their first four and five bytes, hashed. The machine adds
a weight per term and, for every two terms, the product of their factor vectors,
so that pairs such as an insult with a group mention count beyond their sum.

It is fitted on at most ``rows`` distinct labelled texts (a documented bound, chosen by
hash; copies count once, with the mean of their labels, and rows that repeat an id or
tie count like any other), with all their hashed terms that occur in two of these
texts. Their term lists are sparse rows on the driver, bounded by ``rows``. Scoring reads
every whole text, about 60 bytes a byte of it in its task. Null and empty texts get
the score of a text without terms; without anything learned every score is 0.5.
Labels, sources, languages and ids are never inputs of a score. A kept column must not
be called ``score``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.llm.batches import slices
from commentflow.llm.sampling import fewest, hashes, texts_of
from commentflow.llm.shingles import text_bytes, word_hashes

BITS = 22
PREFIXES = (4, 5)
BATCH = 128
SCALE = BATCH / 4  # gradients in units of a quarter of a batch
RATE = 0.3
PENALTY, PAIR_PENALTY = 4.0, 15.0  # what gradients must add up to before a weight or factor moves
START = 0.03  # spread of the factors before they move
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts, one by one, and the text of each."""
    data, starts = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, at, *heads = word_hashes(data, starts, _GAP, PREFIXES)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(at))
    hashes = np.concatenate([words, *heads])
    text = np.tile(text, 1 + len(heads))
    some = hashes != 0
    return (hashes[some] >> np.uint64(64 - BITS)).astype(np.int64), text[some]


def _distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text << BITS | hashes)
    return both & (1 << BITS) - 1, both >> BITS


def _sample_terms(sample: DataFrame) -> DataFrame:
    """Rows (y, terms) of the labelled sample."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                h, at = _distinct(*terms(batch.column("text")))
                offsets = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.astype(np.int32)))],
                    ["y", "terms"],
                )

    return sample.select("y", "text").mapInArrow(run, "y double, terms array<int>")


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = 10_000, factors: int = 8, epochs: int = 6, seed: int = 7,
) -> dict:
    """Fit on texts whose id is in ``labels``; the model holds the terms of the sample
    that have a weight or factor left. Without a labelled text it scores 0.5."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"))
    hashed = hashes(docs, text, F.col(id_col).alias("id")).join(known, "id")
    once = hashed.groupBy(F.lit(0).alias("k"), "h", "d").agg(F.avg("y").alias("y"))
    sample = texts_of(docs, text, fewest(once, rows))
    found = _sample_terms(sample).toArrow()
    y = found["y"].to_numpy().astype(np.float64)
    lists = found["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy()
    counts = np.bincount(flat, minlength=1 << BITS) if len(flat) else np.zeros(1 << BITS, np.int64)
    # A term of one text alone says nothing about others; no term is judged by its label.
    chosen = np.flatnonzero(counts > 1)
    use = counts[flat] > 1
    at = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))[use]
    column = np.searchsorted(chosen, flat[use])
    # A fixed order of rows, however Spark returned them.
    key = np.bincount(at, weights=(column + 1.0) ** 1.5, minlength=len(y)) + y / 2
    order = np.argsort(key, kind="stable")
    fitted = _fit(y, at, column, order, len(chosen), factors, epochs, seed)
    left = np.flatnonzero((fitted["w"] != 0) | fitted["v"].any(axis=1))
    return {"terms": chosen[left], "bias": fitted["bias"], "w": fitted["w"][left], "v": fitted["v"][left]}


def _fit(y, at, column, order, n_terms, factors, epochs, seed) -> dict:
    """Sparse minibatches: only the terms of a batch are touched. Weights and factors
    follow the regularised leader with an absolute penalty, so that weights of chance
    terms are exactly zero and their factors stay where they start."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return {"bias": 0.0, "w": np.zeros(n_terms), "v": np.zeros((n_terms, factors))}
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias, gb = np.log(rate / (1 - rate)), 1.0
    w, zw, nw = np.zeros(n_terms), np.zeros(n_terms), np.zeros(n_terms)
    start = rng.normal(0, START, (n_terms, factors))
    v, zv, nv = start.copy(), np.zeros((n_terms, factors)), np.zeros((n_terms, factors))
    place = np.empty(len(y), np.int64)
    place[order] = np.arange(len(y))
    y = y[order]
    # Rows are dealt to fixed batches, whose entries are sorted by term once.
    batches = []
    dealt = rng.permutation(len(y))
    of = np.empty(len(y), np.int64)
    n_batches = max(1, len(y) // BATCH)
    of[dealt] = np.arange(len(y)) * n_batches // len(y)
    entry = np.lexsort((column, of[place[at]]))
    rows, cols = place[at][entry], column[entry].astype(np.int32)
    cut = np.searchsorted(of[rows], np.arange(n_batches + 1))
    for k in range(n_batches):
        who = np.flatnonzero(of == k)
        r, c = np.searchsorted(who, rows[cut[k] : cut[k + 1]]).astype(np.int32), cols[cut[k] : cut[k + 1]]
        batches.append((who, r, c))
    for _ in range(epochs):
        for k in rng.permutation(n_batches):
            who, r, c = batches[k]
            m = len(who)
            first = np.flatnonzero(np.diff(c, prepend=-1))
            t = c[first]  # the batch's terms
            vc = v[c]
            xv = np.stack([np.bincount(r, vc[:, f], m) for f in range(factors)], axis=1)
            square = np.bincount(r, (vc**2).sum(axis=1), m)
            z = bias + np.bincount(r, w[c], m) + 0.5 * ((xv**2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[who]) / m
            db = float(error.sum())
            gb += (db * 10) ** 2
            bias -= 0.3 * db / np.sqrt(gb)
            if not len(t):
                continue
            g = np.add.reduceat(error[r], first) * SCALE
            dv = np.add.reduceat(error[r][:, None] * (xv[r] - vc), first) * SCALE
            w[t] = _leader(t, g, w[t], zw, nw, PENALTY)
            v[t] = start[t] + _leader(t, dv, v[t] - start[t], zv, nv, PAIR_PENALTY)
    v[(v == start).all(axis=1)] = 0  # never moved: no evidence for a pair
    return {"bias": bias, "w": w, "v": v}


def _leader(t, g, now, z, n, penalty):
    """New values of the touched parameters from their gradients."""
    z[t] += g - (np.sqrt(n[t] + g**2) - np.sqrt(n[t])) / RATE * now
    n[t] += g**2
    return -np.sign(z[t]) * np.maximum(np.abs(z[t]) - penalty, 0) * RATE / (1 + np.sqrt(n[t]))


def score(docs: DataFrame, model: dict, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Per input row: the kept columns and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``terms``

    def run(batches):
        model = shared.value
        place = np.full(1 << BITS, -1, np.int32)
        place[model["terms"]] = np.arange(len(model["terms"]))
        w, v = model["w"], model["v"]
        for whole in batches:
            for batch in slices(whole, "_scored"):
                h, at = terms(batch.column("_scored"))
                known = place[h] >= 0
                h, at = _distinct(h[known], at[known])
                i, rows = place[h], batch.num_rows
                z = model["bias"] + np.bincount(at, weights=w[i], minlength=rows)
                for f in range(v.shape[1]):
                    s = np.bincount(at, weights=v[i, f], minlength=rows)
                    z += 0.5 * (s**2 - np.bincount(at, weights=v[i, f] ** 2, minlength=rows))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p)], [*keep, "score"])

    if "score" in keep:
        raise ValueError("a kept column is called score")
    kept = docs.select(*keep, F.col(text).alias("_scored"))
    return kept.mapInArrow(run, kept.drop("_scored").schema.add("score", "double"))
