"""Vectorised hashing of words and shingles, and fast similarity sketches.

All functions work on flat arrays with offsets: many documents at once, no loop over words.
"""

from __future__ import annotations

import numpy as np

MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Odd steps between the hashes of a family.
LANE = 0xD1B54A32D192ED03


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte, and the same with A-Z taken as a-z.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the first word of each text (one more entry at the end).

    A hash is a sum over a word's bytes of a scrambled number for byte and place: as for sums of independent random numbers, two
    words have it in common with a probability of 2**-64, whatever repeats in them. ``lane`` chooses one of many such hashes.
    """
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = place.astype(np.uint64)
    value *= STEP
    value ^= table[data[at]]
    value += np.uint64(lane * LANE % 2**64)
    return mix(np.add.reduceat(mix(value), first)), np.searchsorted(starts, offsets)


def shingles(word: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, with repeats, and offsets by text; a text of fewer words is one shingle."""
    n = np.diff(first)
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    at = np.repeat(first[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    size = np.repeat(np.minimum(n, k), made)
    out = size.astype(np.uint64) * STEP
    for j in range(k):
        scrambled = np.append(mix(word + np.uint64((j + 1) * LANE % 2**64)), np.zeros(k, np.uint64))
        out += np.where(j < size, scrambled[at + j], np.uint64(0))
    return mix(out), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct values of each stretch in ascending order of values, and the stretches' new offsets."""
    parts = [a + np.unique(values[a:b], return_index=True)[1] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def sketch(values: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """A fast similarity sketch of t coordinates for every set (a row each); empty sets give zeros.

    Round i < t places each element in one of the t bins by hash; round t + b places all elements in bin b, so
    that every bin is filled after 2t rounds at most. A bin keeps the least (round, hash) it has seen, and a
    set stops after the round that fills its last bin, so most sets need a few rounds. Two sets agree in a
    coordinate with a probability that is their Jaccard similarity, and the sum over coordinates concentrates
    as if they were independent.
    """
    n = np.diff(offsets)
    void = np.uint64(2**64 - 1)
    out = np.full((len(n), t), void, np.uint64)
    flat = out.reshape(-1)
    live = np.flatnonzero(n)
    out[n == 0] = 0
    x, size = values, n[live]
    at = np.repeat(live * t, size)
    odd = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    for i in range(2 * t):
        if not len(live):
            break
        h = x * odd[i]
        if i < t:
            place = h >> np.uint64(32)
            place *= np.uint64(t)
            place >>= np.uint64(32)
            place = place.view(np.int64)
            place += at
        else:
            place = at + (i - t)
        h *= MIX2
        h >>= np.uint64(10)
        h |= np.uint64(i) << np.uint64(54)
        np.minimum.at(flat, place, h)
        unfilled = out[live].max(axis=1) == void
        if not unfilled.all():
            keep = np.repeat(unfilled, size)
            live, size = live[unfilled], size[unfilled]
            x, at = x[keep], at[keep]
    return out


def bands(sk: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for every ``rows`` coordinates, different by band."""
    b = sk.shape[1] // rows
    part = sk[:, : b * rows].reshape(len(sk), b, rows)
    key = np.broadcast_to(np.arange(b, dtype=np.uint64) * STEP, part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ part[:, :, r]) + STEP
    return key


def short(sk: np.ndarray) -> np.ndarray:
    """One byte of every coordinate, to estimate similarity with little data."""
    return (mix(sk) >> np.uint64(56)).astype(np.uint8)
