"""Hashes of words and word shingles, computed for many texts at once on bytes."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the hash functions.
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: How many powers of a base a worker keeps.
POWERS_KEPT = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random value for each byte.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def byte_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A value for each byte of all texts, and how many each text has."""
    return _BYTES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; those of usual lengths are kept."""
    known = _POWERS.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.ones(max(n, POWERS_KEPT), np.uint64)
    have, step = 1, base
    while have < len(out):
        more = min(have, len(out) - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    if len(out) == POWERS_KEPT:
        _POWERS[base] = out
    return out[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes but white space, A-Z lower-cased) in order, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * powers(len(data), BASE), out=sums[1:])
    hashes = mixed((sums[ends] - sums[begins]) * powers(len(data), BASE_INVERSE)[begins])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begins, bounds), prepend=0)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and how many each has.

    A shingle is a hash of ``words`` words in a row; a text with fewer words but at least one is one
    shingle by itself. Hashes keep 52 bits, so that text and hash sort as one number; a call takes at
    most 4096 texts.
    """
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    own = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    if n >= words:
        code = hashes[: n - words + 1].copy()
        for i in range(1, words):
            code = code * np.uint64(BASE) + hashes[i : n - words + 1 + i]
        whole = own[: n - words + 1] == own[words - 1 :]
        code, own = mixed(code[whole]), own[: n - words + 1][whole]
    else:
        code, own = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        few = [hashes[starts[i] : starts[i] + counts[i]] for i in short.tolist()]
        alone = np.array([_sequence(x) for x in few], np.uint64)
        code, own = np.concatenate((code, alone)), np.concatenate((own, short.astype(np.uint64)))
    both = np.unique(own << np.uint64(52) | code >> np.uint64(12))
    return both & np.uint64((1 << 52) - 1), np.bincount((both >> np.uint64(52)).astype(np.int64), minlength=len(texts))


def _sequence(hashes: np.ndarray) -> int:
    """A hash of a whole short sequence, apart from those of full shingles by its length."""
    code = len(hashes)
    for h in hashes.tolist():
        code = (code * BASE + h) % (1 << 64)
    return int(mixed(np.array([code ^ 0x5851F42D4C957F2D], np.uint64))[0])
