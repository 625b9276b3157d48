"""Word shingles of whole texts as sorted sets of 64-bit hashes, in numpy.

A batch of texts is hashed from its Arrow buffer: a prefix sum of byte times a
power of an odd base gives every word's polynomial hash at once (arithmetic
modulo 2**64, where an odd base has an inverse), and a bit mixer spreads it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEPT = 1 << 21  # bytes of text whose power tables a worker keeps
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def _kept_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, size), _powers(_UNBASE, size)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; tables for ordinary slices
    of text are made once per worker."""
    if n > KEPT:
        return _powers(_BASE, n), _powers(_UNBASE, n)
    return tuple(t[:n] for t in _kept_powers(KEPT))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(
    data: np.ndarray, starts: np.ndarray, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()
) -> tuple:
    """Hash of every word, per text the number of words before it, and for each
    length in ``prefixes`` the hash of that many first bytes (0 for shorter words)."""
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = space[data]
    begins = ~blank[:-1]
    cut = starts[(starts > 0) & (starts < len(data))]
    inner = begins.copy()
    inner[1:] &= blank[:-2]
    inner[cut] |= begins[cut]  # texts lie side by side: a text start is a word start
    first = np.flatnonzero(inner)
    last_of = ~blank[:-1] & blank[1:]
    last_of[cut - 1] |= begins[cut - 1]
    end = np.flatnonzero(last_of) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    power, inverse = power_tables(len(data))
    np.multiply(_LOWER[data] + np.uint64(1), power, out=sums[1:])
    np.cumsum(sums, out=sums)
    back = inverse[first]
    hashes = mix((sums[end] - sums[first]) * back)
    heads = [
        np.where(end - first >= k, mix((sums[np.minimum(first + k, end)] - sums[first]) * back + np.uint64(k)), np.uint64(0))
        for k in prefixes
    ]
    return hashes, np.searchsorted(first, starts), *heads


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the offsets of each text.

    A text with fewer than five words has its whole word sequence as the only
    shingle; one without words, or null, has none.
    """
    data, starts = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words, at = word_hashes(data, starts)
    n = np.diff(at)
    rows = np.maximum(n - WIDTH + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(rows)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - at[:-1], rows)
    left = np.repeat(at[1:], rows) - place  # words from here to the end of the text
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    total = np.zeros(len(place), np.uint64)
    for k in range(WIDTH):
        total = mix(total + np.where(left > k, padded[place + k], np.uint64(0)) + np.uint64(k + 1))
    fresh = np.ones(len(total), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        total[a:b].sort()
    fresh[1:] = total[1:] != total[:-1]
    fresh[offsets[:-1][rows > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return total[fresh], kept[offsets]


def _run(near: np.ndarray, limit: np.ndarray, at: int, step: int, most: int) -> np.ndarray:
    """How many neighbours in a row share the parent's range, up to ``most``."""
    n = len(limit)
    size, open_ = np.zeros(n, np.int8), np.ones(n, bool)
    for k in range(most):
        open_ &= near[at + step * k : at + step * k + n] <= limit
        size += open_
    return size


def fragment_keys(hashes: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of small fragments of each set, and the set each belongs to.

    The hash order is cut into dyadic ranges, a binary tree of fragments. Let two
    sets differ in at most (100 - percent) % of their union. Then the same holds
    in the root and, below any fragment, in one of its halves; going down ends in
    a fragment whose union is too small for even one difference (``cap`` members),
    where both sets are equal and not empty. A set therefore names its fragments
    of at most ``cap`` members whose parent holds at least ``least`` (what the
    smaller of two such sets must hold there): similar sets share a name.
    """
    cap = -(-100 // (100 - percent)) - 1
    least = -(-percent * (cap + 1) // 100)
    n, pad = len(hashes), cap + 2
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # split[pad + i]: how early in the bits member i parts from member i - 1
    split = np.full(n + 1 + 2 * pad, 100, np.int8)
    apart = hashes[1:] ^ hashes[:-1]
    split[pad + 1 : pad + n] = np.frexp((apart & ~(apart >> np.uint64(1))).astype(np.float64))[1]
    split[pad + offsets] = 100
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    keys, owners = [], []
    for size in range(1, min(cap, n) + 1):
        m = n - size + 1
        parent = np.minimum(split[pad : pad + m], split[pad + size : pad + size + m])
        inner = np.full(m, -1, np.int8)
        for k in range(1, size):
            np.maximum(inner, split[pad + k : pad + k + m], out=inner)
        named = (inner < parent) & (parent < 100)
        more = least - size
        if more > 0:
            around = _run(split, parent, pad, -1, more) + _run(split, parent, pad + size, 1, more)
            named &= around >= more
        at = np.flatnonzero(named)
        keys.append(mix(sums[at + size] - sums[at]))
        owners.append(np.searchsorted(offsets, at, side="right") - 1)
    return np.concatenate(keys), np.concatenate(owners)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of a set: a power of two of at least 1.5 bits per member, and of 4
    for sets of up to 512 members, among which dissimilar pairs are most frequent.

    Two sets of different size differ in at least as many members as their
    sketches (folded to the shorter length) differ in bits.
    """
    bits = max(64, 1 << int(np.ceil(np.log2(max(1.5 * len(hashes), min(4 * len(hashes), 2048), 1)))))
    odd = np.bincount((mix(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def far_apart(sketches: pa.Array, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """True for the pairs (i, j) of rows that their sketches prove dissimilar;
    ``sizes`` holds each row's set size."""
    sketches = sketches.cast(pa.large_binary())
    begins = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(sketches) + 1]
    data = np.frombuffer(sketches.buffers()[2] or b"", np.uint8)
    width = np.diff(begins)
    swap = width[i] < width[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)  # i has the longer sketch

    def rows(at: np.ndarray, w: int) -> np.ndarray:
        return np.ascontiguousarray(data[begins[at][:, None] + np.arange(w)]).view(np.uint64)

    apart = np.zeros(len(i), np.int64)
    kinds = width[i] << 32 | width[j]
    for kind in np.unique(kinds).tolist():
        long, short = kind >> 32, kind & 0xFFFFFFFF
        which = np.flatnonzero(kinds == kind)
        step = max(1, (1 << 22) // long)
        for k in range(0, len(which), step):
            at = which[k : k + step]
            left = rows(i[at], long).reshape(len(at), long // short, short // 8)
            odd = np.bitwise_xor.reduce(left, axis=1) ^ rows(j[at], short)
            apart[at] = np.bitwise_count(odd).sum(axis=1, dtype=np.int64)
    # similar: difference <= (100 - percent) / (100 + percent) * (sum of sizes)
    return apart * (100 + percent) > (100 - percent) * (sizes[i] + sizes[j])
