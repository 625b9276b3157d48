"""Alignment of two tokenizers' tokens on the same text, by interval coalescing.

A is a byte-level BPE vocabulary (a ``tokenizers`` file), B a SentencePiece model. The
text gets one space in front (B adds it itself), and a text takes part only if the
bytes of its A tokens and of its B tokens both give space and text again. Special
tokens' strings inside texts are plain text.

The tokens of many texts are intervals on one line of bytes. All of them are sorted by
start, a running maximum of their ends is kept, and a new group begins where a start
reaches it: there A and B tokens both end. Inside the groups every A token expands to
the B tokens that it overlaps, the links.

How many documents hold an id pair linked is counted over the whole corpus. A task
numbers the distinct pairs of a chunk of documents (about ``CHUNK`` bytes of text) and
stages each document's links as those numbers, and the chunk's pairs with the number
of its documents that hold them. Only the chunks' pairs are summed, looked up and
cogrouped with the chunk's documents again: what is shuffled is a chunk's distinct
pairs, not every document's, no table is broadcast for them, and a pair that every
document holds makes one row per chunk.

Null and empty texts, and those that a tokenizer does not give back (one with U+2581,
say), have no tokens: zeros and an empty ``groups``. Rows that repeat an id, equal rows
and null ids each give a row, and each counts as a document. Ties for an A token's
highest count all count as best. Only the named columns are read. Texts are never cut;
the arrays of one text need about 100 bytes a byte of it in its task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.llm.batches import slices
from commentflow.llm.pieces import SPACE, Encoder, vocabulary
from commentflow.llm.shingles import text_bytes
from commentflow.session import stage

# How the byte-level vocabulary splits text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 24  # bytes of text whose pairs are numbered together
_SLICE = 1 << 20  # bytes of text aligned at a time
_ROW = (
    "chunk long, id {}, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "held binary, times binary, pairs array<long>, docs array<int>"
)


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others in order for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokens:
    """Ids of texts by the vocabulary of a ``tokenizers`` file of the byte-level BPE kind."""

    def __init__(self, definition: str):
        import tiktoken

        self.definition, self._slow = definition, None
        spec = json.loads(definition)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], before.get("type"), before.get("use_regex"), spec["normalizer"]) != ("BPE", "ByteLevel", True, None):
            raise ValueError("not a byte-level BPE vocabulary")
        symbols = byte_symbols()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(symbols.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the order of the merges is not that of the ids")
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self._fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of blanks too long for its pattern matcher
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_str(self.definition)
                self._slow.encode_special_tokens = True
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


def piece_bytes(vocab: dict) -> list[bytes]:
    raw = [p.replace(SPACE, " ").encode("utf-8", "replace") for p in vocab["pieces"]]
    for b, i in enumerate(vocab["bytes"]):
        raw[i] = bytes([b])
    return raw


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For two tilings of one line, given their ends in order: the tokens by start, A
    before B (A's numbers, then B's after them), the group of each, and the links as
    A and B numbers."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([a_ends, b_ends])
    for part in (starts[: len(a_ends)], starts[len(a_ends) :]):
        part[1:], part[:1] = part[:-1].copy(), 0
    order = np.lexsort((np.arange(len(ends)) >= len(a_ends), starts))
    running = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= running[:-1]
    group = np.cumsum(fresh) - 1
    by_group = np.lexsort((order >= len(a_ends), group))  # stable: starts stay in order
    low = np.searchsorted(b_ends, starts[: len(a_ends)], side="right")
    high = np.searchsorted(starts[len(a_ends) :], a_ends, side="left")
    many = high - low
    a = np.repeat(np.arange(len(a_ends)), many)
    b = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(a))
    return order[by_group], group[by_group], a, b


class Aligner:
    """Holds both tokenizers and the tables that print ids."""

    def __init__(self, definition: str, vocab: dict):
        self.a, self.b = ByteTokens(definition), Encoder(vocab)
        raw = self.a.raw + piece_bytes(vocab)
        self.size_a, self.size_b = len(self.a.raw), len(vocab["pieces"])
        self.length = np.array([len(t) for t in raw])
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        numbers = [*map(str, range(self.size_a)), *map(str, range(self.size_b))]
        self.names = [n + mark for n in numbers for mark in ",|;"]

    def _joined(self, tokens: np.ndarray) -> np.ndarray:
        size = self.length[tokens]
        at = np.repeat(self.begin[tokens] - (np.cumsum(size) - size), size)
        return self.bytes[at + np.arange(len(at))]

    def _same(self, tokens: np.ndarray, doc: np.ndarray, line: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which documents' tokens give the line's bytes again."""
        ok = np.bincount(doc, self.length[tokens], len(size)).astype(np.int64) == size
        joined = self._joined(tokens[ok[doc]])
        rest = line[np.repeat(ok, size)]
        wrong = np.repeat(np.arange(len(size)), np.where(ok, size, 0))[joined != rest]
        ok[wrong] = False
        return ok

    def align(self, texts: pa.Array) -> tuple:
        """Per text: A and B tokens, groups, links, the printed groups; and per text and
        distinct id pair, in order: text, pair, number of links."""
        n = len(texts)
        data, at = text_bytes(texts)
        some = np.diff(at) > 0
        size = np.diff(at) + some
        line = np.insert(data, at[:-1][some], 32)
        lists = [self.a.ids(" " + t) if t else np.zeros(0, np.uint32) for t in texts.to_pylist()]
        a_doc = np.repeat(np.arange(n), [len(x) for x in lists])
        a = np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.int64)
        coded = self.b.encode(texts).fill_null([])
        b = coded.flatten().to_numpy().astype(np.int64) + self.size_a
        b_doc = np.repeat(np.arange(n), np.diff(coded.offsets.to_numpy()))
        ok = self._same(a, a_doc, line, size) & self._same(b, b_doc, line, size)
        a, a_doc, b, b_doc = a[ok[a_doc]], a_doc[ok[a_doc]], b[ok[b_doc]], b_doc[ok[b_doc]]

        order, group, i, j = coalesce(np.cumsum(self.length[a]), np.cumsum(self.length[b]))
        tokens, docs = np.concatenate([a, b])[order], np.concatenate([a_doc, b_doc])[order]
        left = order < len(a)
        mark = np.zeros(len(order), np.int64)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(left[1:] != left[:-1], 1, 0))
        named = list(map(self.names.__getitem__, (3 * tokens + mark).tolist()))
        cut = np.searchsorted(docs, np.arange(n + 1)).tolist()
        printed = ["".join(named[p:q]).rstrip(",;") for p, q in zip(cut[:-1], cut[1:], strict=True)]
        heads = np.ones(len(group), bool)
        heads[1:] = group[1:] != group[:-1]
        counts = [np.bincount(d, minlength=n) for d in (a_doc, b_doc, docs[heads], a_doc[i])]

        space = self.size_a * self.size_b
        key = a_doc[i] * space + a[i] * self.size_b + (b[j] - self.size_a)
        key, times = np.unique(key, return_counts=True)
        return (*counts, printed, key // space, key % space, times)


_last: list = []


def _aligner(definition: str, vocab: dict) -> Aligner:
    """The worker's aligner; tasks of one query share a vocabulary object."""
    if not _last or _last[0] is not vocab:
        _last[:] = [vocab, Aligner(definition, vocab)]
    return _last[1]


def _parts(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The values of each owner (in order) as bytes."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.astype("<u4"))])


def _chunked(docs: DataFrame, byte_file: str, piece_file: str, id_col: str, text: str, printed: str) -> DataFrame:
    """Rows of the documents, and after those of a chunk one row with its pairs."""
    spark = docs.sparkSession
    with open(byte_file, encoding="utf-8") as file:
        definition = file.read()
    ByteTokens(definition)  # refuses another kind of vocabulary here, not in a task
    shared = spark.sparkContext.broadcast((definition, vocabulary(piece_file)))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    schema = _ROW.format(narrow.schema["id"].dataType.simpleString())

    def form(texts: list[str]) -> list[str]:
        if printed == "text":
            return texts
        return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]

    def finished(number: int, ids: list, parts: list) -> Iterator[pa.RecordBatch]:
        n = sum(len(p[0]) for p in parts)
        *counts, words, owner, pairs, times = ([p[k] for p in parts] for k in range(8))
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        owner = np.concatenate([o + k for o, k in zip(owner, base, strict=False)])
        known, place = np.unique(np.concatenate(pairs), return_inverse=True)
        held = np.bincount(place, minlength=len(known)).astype(np.int32)
        names = [f.split()[0] for f in schema.split(", ")]
        many = pa.array(np.full(n, number))
        yield pa.RecordBatch.from_arrays(
            [
                many, pa.concat_arrays(ids), *[pa.array(np.concatenate(c)) for c in counts],
                pa.array(form([w for part in words for w in part]), pa.string()),
                _parts(place, owner, n), _parts(np.concatenate(times), owner, n),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
            ],
            names,
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.nulls(1, ids[0].type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([known], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int32())),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _aligner(*shared.value)
        number = TaskContext.get().partitionId() << 32
        ids, parts, filled = [], [], 0
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                ids.append(part.column("id"))
                parts.append(tool.align(part.column("text")))
                filled += part.column("text").nbytes
                if filled >= CHUNK:
                    yield from finished(number, ids, parts)
                    number, ids, parts, filled = number + 1, [], [], 0
        if parts:
            yield from finished(number, ids, parts)

    return narrow.mapInArrow(run, schema)


def _counted(staged: DataFrame, size_b: int) -> DataFrame:
    """Rows (pair, count, best): documents that hold a pair, and whether that is the
    highest count of its A id."""
    each = staged.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = stage(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count")), "align_counts")
    a = F.expr(f"pair div {size_b}").alias("a")
    best = counts.groupBy(a).agg(F.max("count").alias("most"))
    return counts.select("pair", "count", a).join(best, "a").select(
        "a", "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def _scored(staged: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    docs = staged.filter("pairs IS NULL").drop("pairs", "docs")
    wanted = staged.filter("pairs IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(counts.select("pair", "count", "best"), "pair").select("of", "place", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        count[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy()
        sums = np.zeros((2, left.num_rows), np.int64)
        for k, (held, times) in enumerate(zip(left.column("held"), left.column("times"), strict=True)):
            at, n = (np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in (held, times))
            sums[:, k] = best[at] @ n, count[at] @ n
        out = left.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return docs.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def align(
    docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text: str = "text", printed: str = "text"
) -> DataFrame:
    """One row per row: id, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``groups``
    (``a1,a2|b1;a3|b2``, or the SHA-256 of that with ``printed="sha256"``), ``n_best`` (links
    whose pair has the highest count of its A id) and ``count_sum`` (counts over links)."""
    staged = stage(_chunked(docs, byte_file, piece_file, id_col, text, printed), "align")
    kind = staged.schema["id"].dataType.simpleString()
    out = _scored(staged, stage(_counted(staged, _pieces(piece_file)), "align_best"), kind)
    return out.withColumnRenamed("id", id_col)


def pair_counts(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (a, b, ``n_docs``, ``best``): every linked id pair of the corpus."""
    size = _pieces(piece_file)
    staged = stage(_chunked(docs, byte_file, piece_file, id_col, text, "sha256"), "align")
    return _counted(staged, size).select("a", F.expr(f"pair % {size}").alias("b"), F.col("count").alias("n_docs"), "best")


def _pieces(piece_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
