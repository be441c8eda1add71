"""Words and their hashes for many texts at once, in numpy.

A text's bytes are hashed by a polynomial over the ring of 64-bit integers with random byte values; running sums give
the hash of any span as a difference. Two different words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at white space (space, tab to carriage return), and of words of letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1, and those of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if size > 1 << 24:
            return tuple(made)  # of one huge text: not kept
        _powers = tuple(made)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums for span hashes: one more than there are bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def spans(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans."""
    return mixed((running[end] - running[start]) * powers(len(running))[1][start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """All words of some texts: `start` and `end` are byte positions, `first` where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in `inside`, none across two texts."""
    held = inside[data]
    begins, ends = held.copy(), held.copy()
    begins[1:] &= ~held[:-1]
    ends[:-1] &= ~held[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = held[edges]
    ends[edges - 1] = held[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """A-Z in lower case, then runs of the bytes in `inside`."""
    low = LOWER[data]
    start, end = bounds(low, offsets, inside)
    hashes = spans(sums(low), start, end) if len(start) else np.zeros(0, np.uint64)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


#: Factors of a shingle's words.
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words, across texts too: the caller leaves those out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k:len(hashes) - n + 1 + k] * _FACTORS[k]
    return mixed(total + np.uint64(n))


def runs_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The same for the runs that begin at some places only."""
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += hashes[at + k] * _FACTORS[k]
    return mixed(total + np.uint64(n))


def shingles(found: Words, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, ascending; of fewer words, the whole sequence as one; none without words."""
    every, out = runs(found.hash, n), []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= n:
            out.append(distinct(every[a:b - n + 1]))
        elif b > a:
            out.append(runs(found.hash[a:b], b - a))
        else:
            out.append(every[:0])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]
