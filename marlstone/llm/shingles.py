"""Sets of hashed word shingles, computed on whole Arrow buffers.

Words are runs of bytes other than space and the five ASCII white-space controls, A-Z lower-cased. A word's hash is taken from
running sums over the bytes, so no word becomes a Python object. Shingles are 64-bit; two different shingles of one pair of
documents share a hash with a chance of about 1e-13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import slices

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
STEP = U(0x5851F42D4C957F2D)
#: Words a shingle has; a text with fewer is one shingle.
WIDTH = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Shingler:
    def __init__(self, seed: int = 0, width: int = WIDTH):
        self.width = width
        self.letters = mixed(np.arange(1, 257, dtype=U) * GOLD + mixed(np.array([seed + 1], U)))
        self.letters[65:91] = self.letters[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.powers = self.inverses = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n + 1:
            n = max(n + 1, 1 << 18)
            inverse = U(pow(int(STEP), -1, 1 << 64))
            for name, step in (("powers", STEP), ("inverses", inverse)):
                row = np.full(n, step, U)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of some texts, and where each text's words begin (and the last ones end)."""
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not n:
            return np.empty(0, U), np.zeros(len(offsets), np.int64)
        self._grow(n)
        text = data[base : base + n]
        gap = self.gap[text]
        cut = np.zeros(n + 1, bool)
        cut[offsets - base] = True
        begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]) | ~gap & cut[:-1])
        ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]]) | ~gap & cut[1:]) + 1
        sums = np.zeros(n + 1, U)
        np.cumsum(self.letters[text] * self.powers[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[begins]) * self.inverses[begins] + (ends - begins).astype(U) * GOLD)
        return hashes, np.searchsorted(begins, offsets - base)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, sorted distinct shingles) of every row, in order; no shingles where there is no word."""
        for lo, hi in slices(offsets):
            words, firsts = self.words(data, offsets[lo : hi + 1])
            n = max(0, len(words) - self.width + 1)
            joint = np.zeros(n, U)
            for k in range(self.width):
                joint = (joint ^ words[k : k + n]) * MIX1
                joint ^= joint >> U(29)
            joint = mixed(joint)
            firsts = firsts.tolist()
            for k in range(hi - lo):
                begin, end = firsts[k], firsts[k + 1]
                if end - begin >= self.width:
                    own = joint[begin : end - self.width + 1]
                    own.sort()
                    fresh = np.empty(len(own), bool)
                    fresh[0] = True
                    np.not_equal(own[1:], own[:-1], out=fresh[1:])
                    yield lo + k, own[fresh]
                elif end > begin:
                    few = np.array([end - begin], U)
                    for w in words[begin:end]:
                        few = mixed((few ^ w) * GOLD)
                    yield lo + k, few
                else:
                    yield lo + k, np.empty(0, U)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
