"""Minimizers of windows of bytes or words: a content-determined bucket for every string of a fixed length."""

from __future__ import annotations

import numpy as np

from retrace.llm.words import BASE, BASE_INVERSE, mixed, powers


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k units from each position on: of a sum with powers of a base, the part of k terms, shifted back."""
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * powers(len(code), BASE), out=sums[1:])
    return (sums[k:] - sums[:-k]) * powers(len(code), BASE_INVERSE)[: len(code) - k + 1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def minimizer_runs(codes: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts with one minimizer: text, first start, starts, offset of the minimizer from the first start, its hash.

    ``codes`` has a value for each unit (byte or word) of all texts, ``sizes`` how many each text has. The
    minimizer of a window of ``length`` units is the k-gram of least hash in it, the left one of
    equals; equal windows have equal minimizers at equal places, so equal windows are found under one
    hash. Every window start of every text is in exactly one run, and no window is in a run twice.
    """
    nothing = np.zeros(0, np.int64)
    if len(codes) < length:
        return nothing, nothing, nothing, nothing, np.zeros(0, np.uint64)
    begins = np.cumsum(sizes) - sizes
    grams = mixed(gram_hashes(codes, k))
    bits = np.uint64(int(len(grams)).bit_length())
    ordered = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ordered, length - k + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    good = np.arange(len(place)) + length <= (begins + sizes)[own]
    new = good.copy()
    new[1:] &= (place[1:] != place[:-1]) | (own[1:] != own[:-1]) | ~good[:-1]
    first = np.flatnonzero(new)
    # good starts of a text are its first ones, so a run ends where the next begins or its text has no more
    last = np.append(first[1:], len(place))
    ends = np.minimum(last, (begins + sizes)[own[first]] - length + 1)
    return own[first], first - begins[own[first]], ends - first, place[first] - first, grams[place[first]]
