"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes of a class; every class here holds all bytes
of 0x80 and above, so no character is cut. Hashes are 64 bits wide: a
polynomial over random byte values, then mixed.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

warnings.filterwarnings("ignore", "overflow encountered", RuntimeWarning)  # products are meant modulo 2**64
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Words up to so many bytes are hashed in passes over all words, longer ones each alone.
SHORT = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(31))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def lowered(table: np.ndarray) -> np.ndarray:
    """``table`` with A-Z taking the values of a-z."""
    out = table.copy()
    out[65:91] = table[97:123]
    return out


def space_class() -> np.ndarray:
    """Of words [^\\x20\\x09-\\x0D]+: True for bytes of words."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_class() -> np.ndarray:
    """Of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lowered."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x41:0x5B] = table[0x80:] = True
    return table


@dataclass
class Words:
    """Words of a column of texts, in order; word i of text t lies in data[start[i]:end[i]]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # of each word: the row
    first: np.ndarray  # of each row: its first word, and at last the number of words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, table: np.ndarray) -> Words:
    data, offsets = column_bytes(column)
    # A text's end ends a word: a cut is put at every offset.
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, text, first)


def word_hashes(words: Words, values: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes under ``values``; equal words have equal hashes."""
    n = len(words.start)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = words.end - words.start
    power = U(1)
    total = np.zeros(n, np.uint64)
    left = np.arange(n)
    for k in range(min(int(size.max()), SHORT)):
        if k:
            left = left[size[left] > k]
        total[left] += values[words.data[words.start[left] + k]] * power
        power = power * BASE
    for i in np.flatnonzero(size > SHORT):
        powers = np.full(size[i], BASE, np.uint64)
        powers[0] = 1
        total[i] = (values[words.data[words.start[i] : words.end[i]]] * np.multiply.accumulate(powers)).sum(dtype=np.uint64)
    return mix(total + size.astype(np.uint64))


def window_hashes(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that lie in one text, and the index of each one's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= BASE
        total += hashes[k : n + k]
    whole = words.text[:n] == words.text[size - 1 :]
    return mix(total[whole]), np.flatnonzero(whole)
