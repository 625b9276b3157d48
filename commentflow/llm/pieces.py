"""SentencePiece encoding and decoding in batched numpy.

The texts of a batch become one stream of code points, cut wherever no piece can
span; equal parts are encoded once. All distinct parts advance together, one
character at a time: hashes of the substrings that begin there (differences of a
prefix sum) probe a table of piece hashes in bucket order, and an element-wise
maximum keeps the best piece that ends at each place, whose length leads back.

The vocabulary file is of the merge-by-rank kind, where a piece may follow
another only if merging their characters leaves exactly these two. For every
prefix one last piece is possible, so the step's gain is 0 for an allowed pair
and minus infinity otherwise, and the best path is the library's own encoding.
Characters without a piece become byte pieces, as in the library.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentflow.llm.shingles import _powers, mix

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE = 6_000_000  # characters encoded at a time
TOKENS = 1 << 18  # ids decoded at a time


def vocabulary(model_file: str) -> dict:
    """The tables that encoding needs, from a model file: plain lists and arrays.

    Pieces of spaces only are kept apart (they merge last, from the left). For
    the others ``left`` and ``right`` are the two pieces merged last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    _check(model)
    pieces = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    runs = {len(pieces[i]): i for i in plain if set(pieces[i]) == {SPACE}}
    ids = {pieces[i]: i for i in plain if set(pieces[i]) != {SPACE} or len(pieces[i]) == 1}
    by_score = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-model.get_score(i), i))
    rank = np.zeros(size, np.int64)
    rank[by_score] = np.arange(1, len(by_score) + 1)
    left, right = np.full(size, -1), np.full(size, -1)
    merged: dict[str, int] = {p: i for p, i in ids.items() if len(p) == 1}
    for i in by_score:
        parts = list(pieces[i])
        while len(parts) > 2:
            best = min(
                ((rank[merged[parts[k] + parts[k + 1]]], k) for k in range(len(parts) - 1)
                 if parts[k] + parts[k + 1] in merged),
                default=None,
            )
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2 and all(p in merged for p in parts):
            left[i], right[i] = merged[parts[0]], merged[parts[1]]
            merged[pieces[i]] = i
    return {
        "pieces": pieces, "ids": merged, "runs": runs, "rank": rank, "left": left, "right": right,
        "bytes": [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
    }


# Ligature, circled digit, wide letter, double space: a normalising model changes them.
_PROBE = "\ufb01 \u2460 \uff21  x"


def _check(model) -> None:
    """Refuse models on which merging by rank gives other ids than the library."""
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if any(model.get_score(i) != int(model.get_score(i)) for i in plain):
        raise ValueError("the model's scores are no merge ranks (a unigram model, say)")
    if not model.is_byte(model.piece_to_id("<0x00>")) or model.decode(model.encode(_PROBE)) != _PROBE:
        raise ValueError("the model normalises texts or has no byte pieces")


class _Table:
    """Sorted 64-bit keys with values; the top bits index where a bucket begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - 17)
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange((1 << 17) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.begin).max(initial=0))
        self.keys = np.append(self.keys, np.zeros(self.most, np.uint64))

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self.begin[(keys >> self.shift).astype(np.int64)]
        out = np.full(len(keys), missing, np.int64)
        for k in range(self.most):
            hit = np.flatnonzero(self.keys[at + k] == keys)
            hit = hit[at[hit] + k < len(self.values)]
            out[hit] = self.values[at[hit] + k]
        return out


@dataclass
class _Parts:
    codes: np.ndarray  # code points of the distinct parts, longest part first
    start: np.ndarray
    length: np.ndarray


class Encoder:
    """Holds the tables of one vocabulary and a bounded cache of piece pairs."""

    CACHE = 1 << 20

    def __init__(self, vocab: dict):
        self.vocab = vocab
        self.size = len(vocab["pieces"])
        ids = vocab["ids"]
        texts = list(ids)
        self.longest = max(map(len, texts))
        self.lengths = np.ones(self.size, np.int64)
        self.lengths[list(ids.values())] = [len(p) for p in texts]
        prefixes = {p[:k] for p in texts for k in range(1, len(p))} - set(texts)
        known = {**{p: -1 for p in prefixes}, **ids}
        longer = {p[:k] for p in texts for k in range(1, len(p))}
        keys = np.array([self._hash(p) for p in known], np.uint64)
        # value: twice the piece (-1 for none) plus whether a longer piece goes on
        self.table = _Table(keys, np.array([2 * v + (p in longer) for p, v in known.items()], np.int64))
        self.kind = np.zeros(0x110000, np.uint16)
        single = sorted({c for p in texts for c in p})
        self.kind[[ord(c) for c in single]] = np.arange(1, len(single) + 1)
        self.joins = np.zeros((len(single) + 1, len(single) + 1), bool)
        pairs = {p[k : k + 2] for p in texts for k in range(len(p) - 1)}
        if pairs:
            a, b = (self.kind[[ord(p[i]) for p in pairs]] for i in (0, 1))
            self.joins[a, b] = True
        left, right = vocab["left"], vocab["right"]
        has = np.flatnonzero(left >= 0)
        self.merges = _Table(
            mix((left[has] * self.size + right[has]).astype(np.uint64)), vocab["rank"][has]
        )
        self.pair_keys = np.full(self.CACHE, -1, np.int64)
        self.pair_ok = np.zeros(self.CACHE, bool)

    @staticmethod
    def _hash(text: str) -> np.uint64:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return mix(np.sum(codes * _powers(_BASE, len(codes)), dtype=np.uint64, keepdims=True))[0]

    def _valid(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether piece ``two`` can stand after ``one``: undo both sides' merges in
        reverse; no merge across the border may come before the one just undone."""
        rank, left, right = (self.vocab[k] for k in ("rank", "left", "right"))
        ok = np.ones(len(one), bool)
        at = np.arange(len(one))
        one, two = one.copy(), two.copy()
        limit = np.full(len(one), 1 << 40)
        while len(at):
            across = self.merges.find(mix((one * self.size + two).astype(np.uint64)), 1 << 41)
            bad = across < limit
            ok[at[bad]] = False
            on = ~bad & ((rank[one] > 0) | (rank[two] > 0))
            at, one, two = at[on], one[on], two[on]
            undo_one = rank[one] > rank[two]  # equal pieces: the left one merged first
            limit = np.where(undo_one, rank[one], rank[two] + 1)
            one, two = np.where(undo_one, right[one], one), np.where(undo_one, two, left[two])
        return ok

    def valid(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one * self.size + two
        slot = (mix(key.astype(np.uint64)) & np.uint64(self.CACHE - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_ok[slot]
        if len(new):
            fresh, inverse = np.unique(key[new], return_inverse=True)
            ok = self._valid(fresh // self.size, fresh % self.size)
            out[new] = ok[inverse]
            self.pair_keys[slot[new]], self.pair_ok[slot[new]] = key[new], ok[inverse]
        return out

    def _best(self, parts: _Parts) -> np.ndarray:
        """Per character of the parts the piece that begins there, or -1; characters
        without a piece have ``size`` plus their code point."""
        n, most = len(parts.start), int(parts.length[0])
        sums = np.zeros(len(parts.codes) + 1, np.uint64)
        np.cumsum(parts.codes * _powers(_BASE, len(parts.codes)), out=sums[1:], dtype=np.uint64)
        back = _powers(_UNBASE, len(parts.codes))
        longer = n - np.searchsorted(parts.length[::-1], np.arange(most + 1), side="right")
        ends = [np.zeros(0, np.int64)] * (most + 1)  # best piece + 1 that ends after i characters
        for i in range(most):
            m = int(longer[i])  # parts with more than i characters
            first = parts.start[:m] + i
            before = np.zeros(m, np.int64) if i == 0 else ends[i][:m]
            alive = np.arange(m) if i == 0 else np.flatnonzero(before > 0)
            for size in range(1, min(self.longest, most - i) + 1):
                alive = alive[alive < longer[i + size - 1]]
                if not len(alive):
                    break
                s = first[alive]
                value = self.table.find(mix((sums[s + size] - sums[s]) * back[s]), -4)
                piece = value >> 1
                if size == 1:
                    piece = np.where(piece < 0, self.size + parts.codes[s].astype(np.int64), piece)
                got = np.flatnonzero(piece >= 0)
                who, piece = alive[got], piece[got]
                if i:
                    last = before[who] - 1
                    both = np.flatnonzero((last < self.size) & (piece < self.size))
                    allowed = np.ones(len(who), bool)
                    allowed[both] = self.valid(last[both], piece[both])
                    who, piece = who[allowed], piece[allowed]
                if not len(ends[i + size]):
                    ends[i + size] = np.zeros(int(longer[i + size - 1]), np.int64)
                ends[i + size][who] = np.maximum(ends[i + size][who], piece + 1)
                alive = alive[(value & 1 == 1) & (value > -4)]
            if i:
                ends[i] = ends[i].astype(np.int32 if self.size < 1 << 20 else np.int64)
        out = np.full(len(parts.codes), -1, np.int64)
        at = parts.length.copy()
        active = np.arange(n)
        while len(active):
            piece = np.empty(len(active), np.int64)
            for p in np.unique(at[active]).tolist():
                here = np.flatnonzero(at[active] == p)
                piece[here] = ends[p][active[here]] - 1
            size = np.where(piece < self.size, self.lengths[np.minimum(piece, self.size - 1)], 1)
            at[active] -= size
            out[parts.start[active] + at[active]] = piece
            active = active[at[active] > 0]
        return out

    def _stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts and the text each belongs to."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) for t in spaced])
        codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kind[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        ends = np.cumsum(sizes)
        cut[ends[:-1][ends[:-1] < len(codes)]] = True
        begin = np.flatnonzero(cut)
        length = np.diff(begin, append=len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(_BASE, len(codes)), out=sums[1:], dtype=np.uint64)
        key = (sums[begin + length] - sums[begin]) * _powers(_UNBASE, len(codes))[begin]
        del sums
        _, first, inverse = np.unique(key + length.astype(np.uint64), return_index=True, return_inverse=True)
        order = np.argsort(-length[first], kind="stable")
        first = first[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        size = length[first]
        start = np.cumsum(size) - size
        part = _Parts(
            codes[np.repeat(begin[first] - start, size) + np.arange(int(size.sum()))], start, size
        )
        best = self._best(part)
        token = np.flatnonzero(best >= 0)
        owner = np.searchsorted(start, token, side="right") - 1
        count = np.bincount(owner, minlength=len(first))
        offset = np.cumsum(count) - count
        used = place[inverse]
        times = count[used]
        flat = best[token][np.repeat(offset[used] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        text = np.repeat(np.searchsorted(ends, begin, side="right"), times)
        return flat, text

    def _finish(self, flat: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single spaces become space pieces; unknown characters bytes."""
        space = self.vocab["runs"].get(1, -1)
        lone = flat == space
        again = lone[1:] & lone[:-1] & (text[1:] == text[:-1])
        odd = np.flatnonzero(flat >= self.size)
        if again.any() or len(odd):
            keep = np.ones(len(flat), np.int64)  # how many ids each place becomes
            new: dict[int, list[int]] = {}
            for i in odd.tolist():
                raw = chr(int(flat[i]) - self.size).encode("utf-8", "replace")
                new[i] = [self.vocab["bytes"][b] for b in raw]
            run = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
            for a, b in zip(run[::2].tolist(), run[1::2].tolist(), strict=True):
                keep[a : b + 1] = 0
                new[a] = self._spaces(b - a + 1)
            for i, ids in new.items():
                keep[i] = len(ids)
            out, shift = np.repeat(flat, keep), np.cumsum(keep) - keep
            for i, ids in new.items():
                out[shift[i] : shift[i] + len(ids)] = ids
            flat, text = out, np.repeat(text, keep)
        return flat, text

    def _spaces(self, n: int) -> list[int]:
        """Space pieces of a run: all rank equal, so the leftmost pair merges first."""
        runs, parts = self.vocab["runs"], [1] * n
        if n <= max(runs) and n in runs and all(k in runs for k in range(1, n + 1)):
            return [runs[n]]
        k = 0
        while k < len(parts) - 1:
            if parts[k] + parts[k + 1] in runs:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                k = 0
            else:
                k += 1
        return [runs[p] for p in parts]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids per text as ``list<int32>``; null stays null, an empty text has none."""
        size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE
        out = []
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            part = texts.slice(at[0], len(at))
            flat, text = self._finish(*self._stream(part.fill_null("").to_pylist()))
            count = np.bincount(text, minlength=len(part))
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            out.append(pc.if_else(part.is_null(), pa.nulls(len(part), lists.type), lists))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    @cached_property
    def _raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces in a row, where each begins, and how many it has."""
        raw = [p.replace(SPACE, " ").encode("utf-8", "replace") for p in self.vocab["pieces"]]
        for b, i in enumerate(self.vocab["bytes"]):
            raw[i] = bytes([b])
        size = np.array([len(r) for r in raw])
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of id lists, all at once; bytes that are no UTF-8 become the replacement character."""
        lists = ids.fill_null([]) if ids.null_count else ids
        flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if flat.null_count or (len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < self.size):
            raise ValueError("an id list holds a null or an id that the vocabulary lacks")
        token = flat.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(count)])
        group = ends[1:] // TOKENS  # rows decoded together
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(count)] if len(count) else [0]
        parts = [self._texts(token[ends[p] : ends[q]], count[p:q]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
        out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), out)

    def _texts(self, token: np.ndarray, count: np.ndarray) -> pa.Array:
        data, begin, size = self._raw
        n = size[token]
        text = data[np.repeat(begin[token] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        first = ends[:-1][ends[1:] > ends[:-1]]
        first = first[text[first] == 32]  # the space that encoding puts in front
        keep = np.ones(len(text), bool)
        keep[first] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[ends]
        out = pa.Array.from_buffers(
            pa.large_binary(), len(count), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[keep].tobytes())]
        )
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in out], pa.string())


_last: list = []


def _encoder(vocab: dict) -> Encoder:
    """The worker's encoder; tasks of one query share a vocabulary object."""
    if not _last or _last[0] is not vocab:
        _last[:] = [vocab, Encoder(vocab)]
    return _last[1]


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of every text, and on request the text decoded from them again.

    The tables of the vocabulary (a few MB, fixed) are broadcast, so executors
    need no model file. Null texts have null ids, empty ones none; equal texts have equal
    ids, and rows that repeat stay. A text is encoded whole, at about 100 bytes a
    character. Input columns stay, whatever their names, and one that has the name of a
    new column is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(model_file))
    extra = [ids] + ([decoded] if decoded else [])
    last = _free("_text", docs.columns)
    kept = docs.withColumn(last, F.col(text)).drop(*extra)

    def run(batches):
        coder = _encoder(shared.value)
        for batch in batches:
            got = coder.encode(batch.column(len(batch.columns) - 1))
            columns = [*batch.columns[:-1], got] + ([coder.decode(got)] if decoded else [])
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *extra])

    schema = kept.drop(last).schema.add(ids, T.ArrayType(T.IntegerType()))
    return kept.mapInArrow(run, schema.add(decoded, "string") if decoded else schema)


def decode(df: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of every id list of a stored column; a null list has a null text.

    A null or an unknown id inside a list is an error: such a column comes from
    elsewhere. Other columns stay, one with the name of the new column is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(model_file))
    last = _free("_ids", df.columns)
    kept = df.withColumn(last, F.col(ids).cast("array<int>")).drop(*[text] if text != ids else [])

    def run(batches):
        coder = _encoder(shared.value)
        for batch in batches:
            columns, names = list(batch.columns[:-1]), batch.schema.names[:-1]
            got = coder.decode(batch.column(len(names)))
            if text in names:  # the ids' own column
                columns[names.index(text)] = got
                yield pa.RecordBatch.from_arrays(columns, names)
            else:
                yield pa.RecordBatch.from_arrays([*columns, got], [*names, text])

    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in kept.drop(last).schema.fields]
    schema = T.StructType(fields) if text in kept.columns else T.StructType(fields).add(text, "string")
    return kept.mapInArrow(run, schema)


def _free(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
