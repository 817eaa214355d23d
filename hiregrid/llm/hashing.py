"""Hashes of words and of word windows, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit numbers over their range (the finalizer of SplitMix64), differently for each seed."""
    x = x + U((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(256, dtype=U)) | U(1)
POWERS: dict[U, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base^0 … base^(n-1), from a table that grows with the longest text a worker has met."""
    held = POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 14, 2 * len(held) if held is not None else 0), base, U)
        held[0] = U(1)
        POWERS[base] = held = np.multiply.accumulate(held)
    return held[:n]


class Words:
    """The words of one text as 64-bit hashes, and where they are in the bytes."""

    def __init__(self, text: bytes, table: bytes):
        """``table`` maps every separator to a space, and only those."""
        data = np.frombuffer(text.translate(table), np.uint8)
        solid = np.concatenate(([False], data != 32, [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        # Prefix sums of byte * base^position; a word's sum, divided by the power of its start, does not depend on the place.
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTES[data] * powers(ODD, len(data)), out=sums[1:])
        inverse = powers(INVERSE, len(data) + 1)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def __len__(self) -> int:
        return len(self.starts)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for every run of ``size`` words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(mix(words, seed + 1) * powers(ODD, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(INVERSE, n), seed)


def span_hashes(words: np.ndarray, firsts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash for every run of words from one of ``firsts`` up to, without, one of ``ends``."""
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(mix(words, seed + 1) * powers(ODD, len(words)), out=sums[1:])
    inverse = powers(INVERSE, len(words))
    return mix((sums[ends] - sums[firsts]) * inverse[firsts] + mix((ends - firsts).astype(U), seed), seed)


def running_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out
