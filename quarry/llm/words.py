"""Vectorised words of a batch of texts: hashes of whole words, of word
prefixes and of word shingles, computed with numpy over the batch's UTF-8
bytes. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with
A-Z lower-cased.

The hash of a byte run is ``sum(R[b_j] * B**j)`` modulo 2**64, ``R`` being a
table of random words and ``B`` odd, so any run's hash comes from a running
sum by two look-ups; a 64-bit finaliser mixes it with the run's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 1 << 18          # bytes hashed at once: keeps the temporaries in cache
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, filled = base, 1
    while filled < n:
        m = min(filled, n - filled)
        out[filled:filled + m] = out[:m] * np.uint64(pow(base, filled, 1 << 64))
        filled += m
    return out


_POW = _powers(_BASE, PIECE + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)
_RAND = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROW = _RAND[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    hash: np.ndarray        # uint64, one per word, in text order
    start: np.ndarray       # byte offset of the word in the batch
    end: np.ndarray
    per_doc: np.ndarray     # words of each text


def _run_hash(sums, base, start, end, length):
    h = (sums[end] - sums[start]) * _INV[start]
    return mix(h + mix(length.astype(np.uint64)))


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    per_doc = np.diff(np.searchsorted(start, offsets))
    return start, end, per_doc


def hash_words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()):
    """``Words`` of the batch and, for each length in ``prefixes``, the
    hashes of the words' first bytes (0 where a word is not longer)."""
    start, end, per_doc = find_words(data, offsets)
    full = np.empty(len(start), np.uint64)
    pre = [np.zeros(len(start), np.uint64) for _ in prefixes]
    w = 0
    while w < len(start):
        lo = start[w]
        stop = int(np.searchsorted(end, lo + PIECE, side="right"))
        if stop == w:                      # one word longer than a piece
            h, at, k = np.zeros(1, np.uint64), lo, 0
            while at < end[w]:             # fold its pieces, each with its number
                piece = data[at:min(at + PIECE, end[w])]
                part = (_ROW[piece] * _POW[:len(piece)]).sum(dtype=np.uint64, keepdims=True)
                h = mix(h + part + np.uint64(k))
                at, k = at + len(piece), k + 1
            full[w] = h[0]
            for p, length in zip(pre, prefixes):
                s = (_ROW[data[lo:lo + length]] * _POW[:length]).sum(dtype=np.uint64)
                p[w] = mix(np.array([s], np.uint64) + mix(np.array([length], np.uint64)))[0]
            w += 1
            continue
        hi = end[stop - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_ROW[data[lo:hi]] * _POW[:hi - lo], out=sums[1:])
        s, e = start[w:stop] - lo, end[w:stop] - lo
        full[w:stop] = _run_hash(sums, _BASE, s, e, e - s)
        for p, length in zip(pre, prefixes):
            longer = np.flatnonzero(e - s > length)
            a = s[longer]
            p[w + longer] = _run_hash(sums, _BASE, a, a + length, np.full(len(a), length))
        w = stop
    return Words(full, start, end, per_doc), pre


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of every text, in order, and their
    number per text. A text of 1 to n-1 words has its whole sequence as the
    one shingle; a text without words has none."""
    per = words.per_doc
    counts = np.where(per >= n, per - n + 1, np.minimum(per, 1))
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.uint64), counts
    first_word = np.repeat(np.cumsum(per) - per, counts)
    first_out = np.repeat(np.cumsum(counts) - counts, counts)
    at = first_word + (np.arange(total) - first_out)
    size = np.repeat(np.minimum(per, n), counts)
    h = mix(size.astype(np.uint64))
    for k in range(n):
        has = size > k
        nxt = words.hash[np.minimum(at + k, len(words.hash) - 1)]
        h = np.where(has, mix(h * np.uint64(0xD6E8FEB86659FD93) + nxt), h)
    return h, counts


def distinct_per_doc(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their number per text."""
    out, n = [], np.zeros(len(counts), np.int64)
    at = 0
    for i, c in enumerate(counts):
        if c:
            u = np.unique(h[at:at + c])
            out.append(u)
            n[i] = len(u)
            at += c
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), n


def doc_chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about ``most`` bytes (one text at least), so that
    temporaries stay bounded whatever the batch size."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
