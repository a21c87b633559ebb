"""Words of Arrow text columns as 64-bit hashes, found with array operations on the UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Its hash is a polynomial in an odd
base over random byte values modulo 2**64, taken from prefix sums and mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
EXACT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # tells A-Z from a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that part tokens where punctuation doesn't count: ASCII other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(max(n + n // 4, SLICE_BYTES * 5 // 4), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and len + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def bounds(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in raw, and for each text (offsets into raw) its first word: texts + 1 numbers."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~space.take(raw)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:] & (cut | ~word[:-1]))
    ends = np.flatnonzero(word[:-1] & (cut | ~word[1:]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values.take(raw) * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts: first row, end row, the hashes of their words, and for each row its first word (rows + 1)."""
    raw, offsets = text_bytes(texts)
    for lo, hi in slices(offsets):
        own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = bounds(own, at, space)
        yield lo, hi, hashes(own, starts, ends), first


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of the columns, in order."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + c)
    return h


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the row of each; a row of fewer words has one of its whole sequence."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    n = len(words)
    if n >= k:
        full = row[: n - k + 1] == row[k - 1 :]
        h = fold([words[i : n - k + 1 + i] for i in range(k)])[full]
        owner = row[: n - k + 1][full]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for r in short:
            w = words[first[r] : first[r + 1]]
            extra.append(fold([*(w[i : i + 1] for i in range(len(w))), np.array([0xA5A5 + len(w)], np.uint64)]))
        h, owner = np.concatenate([h, *extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner
