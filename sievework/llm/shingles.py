"""Word shingles of whole texts as sorted sets of 64-bit hashes, in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .tokenise import SPACE

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP, STEP_WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 1024  # bytes of a stretch beyond which all of it is digested at once


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64; Steele et al., 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last byte of each word."""
    space = SPACE[data]
    begins, stops = ~space, ~space
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = ~space[cuts]
    cuts = cuts[cuts > 0]
    stops[cuts - 1] = ~space[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, A-Z lowered, taken eight bytes at a time."""
    size = last + 1 - first
    low = np.zeros(-(-len(data) // 8) * 8 + 16, np.uint8)
    np.take(LOWER, data, out=low[: len(data)])
    out = mix((_eight(low, first) & MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * STEP)
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG:
        rest = size[more] - at
        out[more] = mix(out[more] * STEP_WORD + (_eight(low, first[more] + at) & MASK[np.minimum(rest, 8)]))
        more, at = more[rest > 8], at + 8
    for i in more.tolist():
        out[i] ^= np.uint64(int.from_bytes(blake2b(low[first[i] : last[i] + 1].tobytes(), digest_size=8).digest(), "little"))
    return out


def _eight(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    aligned, begin = low.view("<u8"), at >> 3
    shift = ((at & 7) << 3).astype(np.uint64)
    return aligned[begin] >> shift | (aligned[begin + 1] << np.uint64(1)) << (np.uint64(63) - shift)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words before each text's end (n + 1 values)."""
    first, last = word_spans(data, ends)
    return span_hashes(data, first, last), np.searchsorted(first, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``size`` words, sorted, with n + 1 offsets.

    A text of fewer words has all of them as its one shingle; a text of none has none.
    """
    words, at = word_hashes(data, ends)
    counts = np.diff(at)
    whole = np.zeros(len(words), np.uint64)
    for k in range(size):
        part = words[k:] if k else words
        whole[: len(part)] = whole[: len(part)] * STEP_WORD + part
    whole = mix(whole + np.uint64(size))
    out, offsets = [], np.zeros(len(counts) + 1, np.int64)
    for i in range(len(counts)):
        n = int(counts[i])
        if n >= size:
            found = np.unique(whole[at[i] : at[i] + n - size + 1])
        elif n:
            value = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[at[i] : at[i] + n]:
                    value = value * STEP_WORD + w
                found = mix(np.array([value + np.uint64(n)], np.uint64))
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        offsets[i + 1] = offsets[i] + len(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets
