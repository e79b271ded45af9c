"""Minimizers of byte strings, and suffix arrays by linear grouping."""

from __future__ import annotations

import numpy as np

from palimpsest.llm.textbytes import BASE, U, byte_values, mix

GRAM = 32
#: The inverse of BASE modulo 2**64.
BACK = U(pow(int(BASE), -1, 2**64))


class Sums:
    """Prefix sums of a byte string, from which the hash of any of its substrings follows."""

    def __init__(self, data: np.ndarray, seed: int):
        n = len(data)
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_values(seed)[data] * power[:-1], out=self.sums[1:])
        power[:] = BACK
        power[0] = 1
        self.back = np.multiply.accumulate(power, out=power)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values: prefix minima of blocks met by suffix minima."""
    n = len(values)
    if n < size:
        return values[:0]
    rows = -(-n // size)
    padded = np.full(rows * size, values.dtype.type(-1) if values.dtype.kind != "u" else np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, window: int, sums: Sums) -> tuple[np.ndarray, ...]:
    """Runs of strings of ``length`` bytes with one minimizer: text, minimizer, first and last start.

    The minimizer of a string is the place of the least ``GRAM``-byte hash
    among its first ``window`` places, the last of equals: equal strings have
    it at the same place. ``data`` holds the texts between ``offsets``.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    if len(data) < length:
        return none, none, none, none
    at = np.arange(n)
    values = (sums.hash(at, at + GRAM) >> U(32) << U(32)) | (U(2**32 - 1) - at.astype(np.uint64))
    least = least_in_windows(values, window)
    sizes = np.diff(offsets)
    has = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), has)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(has) - has, has))
    if not len(start):
        return none, none, none, none
    place = (U(2**32 - 1) - (least[start] & U(2**32 - 1))).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return text[first], place[first], start[first], start[last]


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order, by grouping.

    First the suffixes are grouped by their longest Lyndon prefix. Groups are
    taken from the greatest down. A taken suffix i finds the nearest earlier
    suffix of a lesser group by the pointers of those passed before: that
    suffix's prefix ends where i begins, and grows by i's. Those that grow are
    split off their group, above it, by how often they grow. Then the suffixes
    come out from the least up: when one comes out, those whose Lyndon prefix
    ends before it, found along the same pointers, take the next places of
    their groups. Each step is linear, and nothing is renamed and sorted anew.
    """
    n = len(symbols)
    size = [1] * n  # of the Lyndon prefix known so far
    before = [-1] * n  # the previous smaller suffix
    members: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        members.setdefault(s, []).append(i)
    lists = [members[s] for s in sorted(members)]
    lower, above = list(range(-1, len(lists) - 1)), [*range(1, len(lists)), -1]
    group = [0] * n
    for g, own in enumerate(lists):
        for i in own:
            group[i] = g
    done = [False] * len(lists)
    taken: list[list[int]] = []  # groups from the greatest down
    g = len(lists) - 1
    while g >= 0:
        own = [i for i in lists[g] if group[i] == g]
        lists[g] = []
        done[g] = True
        if own:
            own.sort()
            taken.append(own)
            length = size[own[0]]
            times: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[group[j]]:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            split: dict[tuple[int, int], list[int]] = {}
            for j, c in times.items():
                split.setdefault((group[j], c), []).append(j)
            last = last_old = -1
            for old, c in sorted(split):  # above its group, by how often it grows
                below = last if old == last_old else old
                new, up = len(lists), above[below]
                lists.append(split[old, c])
                done.append(False)
                lower.append(below)
                above.append(up)
                above[below] = new
                if up >= 0:
                    lower[up] = new
                for j in split[old, c]:
                    group[j] = new
                    size[j] += c * length
                last, last_old = new, old
        g = lower[g]

    place = [0] * n  # of each suffix: its group, counted from the least
    free = []
    total = 0
    for k, own in enumerate(reversed(taken)):
        free.append(total)
        total += len(own)
        for i in own:
            place[i] = k
    out = [0] * n
    j = n
    for at in range(-1, n):
        if at >= 0:
            j = out[at]
        i = j - 1
        while i >= 0 and i + size[i] == j:
            out[free[place[i]]] = i
            free[place[i]] += 1
            i = before[i]
    return out
