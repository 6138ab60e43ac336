"""Windows of fixed length over element sequences, gathered into pieces that equal windows share.

A window's anchor is its least gram (``gram`` elements in a row, by hash, the
leftmost of equals). It depends on the window alone, so equal windows have equal
anchors at equal places. Neighbouring windows mostly share an anchor; a run of
them is a *piece*: a few dozen windows in one row. Windows can only be equal
if the hashes of their anchors are, and pieces of the same content and anchor
place hold the same windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Rabin-Karp: sums of value * BASE^position modulo 2^64, moved to a common place by the inverse of BASE
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the public SplitMix64 finisher)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base^0 .. base^(count - 1) modulo 2^64, by doubling."""
    found = np.ones(max(count, 1), dtype=np.uint64)
    done, step = 1, int(base)
    while done < count:
        take = min(done, count - done)
        found[done : done + take] = found[:take] * np.uint64(step)
        done += take
        step = step * step % (1 << 64)
    return found[:count]


class Hashes:
    """Rabin-Karp hashes of any ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        count = len(values)
        self.inverse = powers(INVERSE, count + 1)
        self.sums = np.zeros(count + 1, dtype=np.uint64)
        np.cumsum(values * powers(BASE, count), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


@dataclass(frozen=True)
class Shape:
    """Window and anchor lengths in elements. ``spread`` is how many grams a window has."""

    window: int
    gram: int

    @property
    def spread(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Pieces:
    """Arrays with one entry per piece: first window, number of windows, anchor's hash, hash of content and anchor place."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    content: np.ndarray


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def find_pieces(hashes: Hashes, lengths: np.ndarray, shape: Shape) -> Pieces:
    """Pieces of many sequences that lie one after the other; windows stay inside their sequence."""
    total = int(lengths.sum())
    count = total - shape.window + 1
    if count <= 0:
        return Pieces(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64)))
    place = np.arange(total - shape.gram + 1)
    grams = hashes.of(place, place + shape.gram)
    # the leftmost of the least: places are ordered by taking away the upper bits they need
    bits = np.uint64(int(len(grams)).bit_length())
    ranked = (grams >> bits << bits) | place.astype(np.uint64)
    anchor = (_sliding_least(ranked, shape.spread)[:count] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(lengths)
    inside = np.zeros(total + 1, dtype=np.int64)
    begins = ends - lengths
    fits = lengths >= shape.window
    np.add.at(inside, begins[fits], 1)
    np.add.at(inside, ends[fits] - shape.window + 1, -1)
    valid = np.cumsum(inside)[:count] > 0
    new = np.ones(count, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[np.minimum(begins[fits], count - 1)] = True
    start = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
    at = anchor[start]
    content = hashes.of(start, stop + shape.window - 1)
    content = mixed(content ^ ((at - start).astype(np.uint64) * INVERSE))
    return Pieces(start, stop - start, grams[at], content)
