"""Words of whole Arrow buffers: where they stand, numbers and fingerprints for them, and texts of the words that are kept.

Words are runs of bytes other than space and the five ASCII white-space controls, unchanged. No word becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import GOLD, MIX1, STEP, U, mixed

GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True


class Words:
    """The words of some texts, given as UTF-8 bytes and n + 1 offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        self.text = data[base : int(offsets[-1])]
        gap = GAP[self.text]
        cut = np.zeros(len(gap) + 1, bool)
        cut[offsets - base] = True
        self.begins = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | cut[:-1])) if len(gap) else np.empty(0, np.int64)
        self.ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | cut[1:])) + 1 if len(gap) else np.empty(0, np.int64)
        #: Number of the first word of each text, and of all words.
        self.firsts = np.searchsorted(self.begins, offsets - base)

    def __len__(self) -> int:
        return len(self.begins)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def numbers(self) -> np.ndarray:
        """A number for each word: equal ones for equal words, from 0."""
        if not len(self):
            return np.empty(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.ends - self.begins)])
        letters = np.ascontiguousarray(self.text[~GAP[self.text]])
        column = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)])
        return column.dictionary_encode().indices.to_numpy().astype(np.int64)

    def prints(self, seed: int) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        n = len(self.text)
        if not len(self):
            return np.empty(0, U)
        letters = mixed(np.arange(1, 257, dtype=U) * GOLD + mixed(np.array([seed + 1], U)))
        up, down = np.full(n, STEP, U), np.full(n, U(pow(int(STEP), -1, 1 << 64)), U)
        up[0] = down[0] = 1
        sums = np.zeros(n + 1, U)
        np.cumsum(letters[self.text] * np.multiply.accumulate(up), out=sums[1:])
        return mixed((sums[self.ends] - sums[self.begins]) * np.multiply.accumulate(down)[self.begins] + (self.ends - self.begins).astype(U) * GOLD)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        rows = len(self.firsts) - 1
        sizes = (self.ends - self.begins)[kept]
        row = self.row_of()[kept]
        later = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.empty(0, bool)
        total = sizes + later  # a space stands before every word but the first
        stops = np.cumsum(total)
        out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
        places = np.repeat(stops - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        source = np.repeat(self.begins[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out[places] = self.text[source]
        bounds = np.concatenate([[0], stops])[np.searchsorted(row, np.arange(rows + 1))]
        return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of what a and b stand for, one after the other."""
    return mixed((a ^ (b * GOLD + MIX1)) * MIX1 + (b >> U(29)))


def grams(prints: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of width words, made by doubling; none where there are fewer words."""
    if len(prints) < width:
        return np.empty(0, U)
    n = len(prints) - width + 1
    found, power, at, size = None, prints, 0, 1
    while True:
        if width & size:
            found = power[:n] if found is None else joint(found, power[at : at + n])
            at += size
        size *= 2
        if size > width:
            return found
        power = joint(power[: len(power) - size // 2], power[size // 2 :])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every width neighbouring ones."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])
