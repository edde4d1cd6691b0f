"""Vectorised kernels over the UTF-8 bytes of one text at a time.

Words are runs of bytes that are no separators; A-Z count as a-z. A word's
hash is a polynomial over random byte values, taken from running sums, so
that no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_SEGMENT = 1 << 20

_values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CASED_VALUES = _values.copy()
FOLDED_VALUES = _values.copy()
FOLDED_VALUES[65:91] = FOLDED_VALUES[97:123]

#: Space and \t to \r separate words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: All ASCII that is no digit or letter separates words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_RATIO), -1, 1 << 64))
        tables = []
        for ratio in (_RATIO, inverse):
            t = np.full(size, ratio, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over the whole word; one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return h


def spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators."""
    outside = np.ones(len(data) + 2, bool)
    np.take(separators, data, out=outside[1:-1])
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    return edges[0::2], edges[1::2]


def _word_hashes(data: np.ndarray, separators: np.ndarray, values: np.ndarray) -> np.ndarray:
    return span_hashes(data, *spans(data, separators), values)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED_VALUES) -> np.ndarray:
    """A hash for each of some runs of bytes."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    own = np.take(values, data)
    own *= power[: len(data)]
    np.cumsum(own, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, separators: np.ndarray = SPACE, values: np.ndarray = FOLDED_VALUES) -> np.ndarray:
    """A 64-bit hash for each word of text, in order. Long texts go in segments cut at a separator."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= _SEGMENT:
        return _word_hashes(data, separators, values)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SEGMENT)
        while end < len(data) and not separators[data[end]]:
            cut = np.flatnonzero(separators[data[end : end + 4096]])
            end = end + int(cut[0]) if len(cut) else min(len(data), end + 4096)
        parts.append(_word_hashes(data[at:end], separators, values))
        at = end
    return np.concatenate(parts)


def equal_groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct value stands, and for each value the number of its group."""
    n = len(hashes)
    bits = max(8, int(n).bit_length() + 2)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    own = np.arange(n)
    table = np.empty(1 << bits, np.int64)
    table[slot] = own
    chosen = table[slot]
    bad = np.flatnonzero(hashes[chosen] != hashes)
    if len(bad):
        _, first, group = np.unique(hashes[bad], return_index=True, return_inverse=True)
        chosen[bad] = bad[first][group]
    is_chosen = chosen == own
    return np.flatnonzero(is_chosen), (np.cumsum(is_chosen) - 1)[chosen]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of size words, in order; of fewer words one for the whole; of none nothing."""
    n = min(size, len(words))
    if not n:
        return words[:0]
    count = len(words) - n + 1
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = out * _RATIO + words[k : k + count]
        out ^= out >> np.uint64(31)
    return mix(out)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of text as a sorted array."""
    return np.unique(shingle_hashes(word_hashes(text or b""), size))
