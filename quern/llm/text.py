"""NumPy kernels over the raw UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r.  All hashes are 64 bit and the same
in every process.  Work is cut into slices of whole documents of about ``SLICE`` bytes, so memory follows the
slice (or one very long document), never the Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U64 = np.uint64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


#: Factors and offsets of the two independent lanes of span_hashes2.
_LANES = ((U64(0x9FB21C651E98DF25), U64(0x2545F4914F6CDD1D)), (U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F)))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 2048


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for slices of whole texts; null counts as empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end).

    separator: for each byte value whether it ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def span_hashes2(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """Independent 64-bit hashes of each byte range, two of them 128 bits: the range's 8-byte pieces are mixed in one
    after the other, so no construction of repeats or complements makes two ranges equal as sums of powers would."""
    size = end - start
    out = [size.astype(U64) * by + add for by, add in _LANES[:lanes]]
    if not len(start):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    pieces = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    piece = pieces[start] & _KEEP[np.minimum(size, 8)]
    for k, (by, add) in enumerate(_LANES[:lanes]):
        out[k] = mix((out[k] ^ piece) * by + add)
    live = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    at, left = start[live] + 8, size[live] - 8
    while len(live):
        piece = pieces[at] & _KEEP[np.minimum(left, 8)]
        for h, (by, add) in zip(out, _LANES[:lanes], strict=True):
            h[live] = mix((h[live] ^ piece) * by + add)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        for k, h in enumerate(out):
            h[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return span_hashes2(data, start, end, 1)[0]


_GRAM = 0xD6E8FEB86659FD93


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; position i covers words i to i+k-1."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = word[:n].copy()
    for j in range(1, k):
        h *= U64(_GRAM)
        h += word[j : j + n]
    return mix(h)


def own_grams(first_word: np.ndarray, k: int) -> np.ndarray:
    """Positions i whose words i to i+k-1 belong to one document."""
    count = np.maximum(np.diff(first_word) - k + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64)
    shift = first_word[:-1] - (np.cumsum(count) - count)
    return np.arange(count.sum()) + np.repeat(shift, count)
