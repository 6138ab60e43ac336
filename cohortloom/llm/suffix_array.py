"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than the next one. The
leftmost S suffixes (LMS) are sorted by their substrings, which get names in
that order; if names repeat, the string of names is sorted the same way. The
order of the LMS suffixes then induces that of the L suffixes in one pass from
the left and of the S suffixes in one from the right. Strings over few symbols
induce bucket by bucket with numpy, also for the order of the substrings;
strings over many (of names) sort their substrings by keys and induce one by one.
"""

from __future__ import annotations

import numpy as np

FEW_SYMBOLS = 1024


def _smaller(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol is the one least sentinel and counts as S."""
    rises = np.diff(text)
    place = np.where(rises != 0, np.arange(len(rises)), len(rises))
    following = np.minimum.accumulate(place[::-1])[::-1]  # the next place at which neighbours differ
    return np.append(rises[np.minimum(following, len(rises) - 1)] > 0, True)


def _induce_few(text: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], ends[:-1]])
    size = len(ends)
    found = np.full(len(text), -1, dtype=np.int64)

    def place(items: np.ndarray, at: np.ndarray, step: int) -> None:
        """Stable: each symbol's items go to its next free places, upwards or downwards."""
        symbols = text[items]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        counts = np.bincount(symbols, minlength=size)
        nth = np.arange(len(items)) - (np.cumsum(counts) - counts)[symbols]
        found[at[symbols] + nth if step > 0 else at[symbols] - 1 - nth] = items[order]
        at += step * counts

    # LMS suffixes wait at the ends of their buckets, in their order
    waiting = np.bincount(text[lms], minlength=size)
    free = ends.copy()
    place(lms[::-1], free, -1)
    heads = starts.copy()
    for symbol in range(size):
        done = starts[symbol]
        while done < heads[symbol]:
            upto = heads[symbol]
            before = found[done:upto] - 1
            before = before[before >= 0]
            place(before[~small[before]], heads, 1)
            done = upto
        before = found[ends[symbol] - waiting[symbol] : ends[symbol]] - 1
        before = before[before >= 0]
        place(before[~small[before]], heads, 1)
    tails = ends.copy()
    for symbol in range(size - 1, -1, -1):
        done = ends[symbol]
        while done > tails[symbol]:
            downto = tails[symbol]
            before = found[downto:done][::-1] - 1
            before = before[before >= 0]
            place(before[small[before]], tails, -1)
            done = downto
        before = found[starts[symbol] : heads[symbol]][::-1] - 1
        before = before[before >= 0]
        place(before[small[before]], tails, -1)
    found[0] = len(text) - 1  # the sentinel follows nothing
    return found


def _induce_many(text: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """One by one. A list's iterators see what is stored ahead of them, as the passes need."""
    size = len(text)
    tails = ends.tolist()
    symbols = text.tolist()
    found = [size] * size  # ``size`` stands for an empty place
    for item in reversed(lms.tolist()):
        symbol = symbols[item]
        tails[symbol] -= 1
        found[tails[symbol]] = item
    # for each place the symbol before it if that suffix is L (then S), else -1
    before = np.concatenate([[-1], np.where(small[:-1], -1, text[:-1]), [-1]]).tolist()
    heads = [0, *ends[:-1].tolist()]
    for item in found:
        symbol = before[item]
        if symbol >= 0:
            at = heads[symbol]
            found[at] = item - 1
            heads[symbol] = at + 1
    before = np.concatenate([[-1], np.where(small[:-1], text[:-1], -1), [-1]]).tolist()
    tails = ends.tolist()
    for item in reversed(found):
        symbol = before[item]
        if symbol >= 0:
            at = tails[symbol] - 1
            found[at] = item - 1
            tails[symbol] = at
    found[0] = size - 1
    return np.array(found, dtype=np.int64)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, and how many there are; ``ordered`` are the LMS places by substring."""
    length = np.zeros(len(text), dtype=np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    left, right = ordered[:-1], ordered[1:]
    same = length[left] == length[right]
    open_pairs, offset = np.flatnonzero(same), 0
    while len(open_pairs):
        a, b = left[open_pairs] + offset, right[open_pairs] + offset
        equal = text[a] == text[b]
        same[open_pairs[~equal]] = False
        offset += 1
        open_pairs = open_pairs[equal & (length[left[open_pairs]] > offset)]
    names = np.concatenate([[0], np.cumsum(~same)])
    by_place = np.empty(len(text), dtype=np.int64)
    by_place[ordered] = names
    return by_place[lms], int(names[-1]) + 1


def _names_of_many(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The same for strings over many symbols: as many symbols (with their type) as fit a key are sorted at once,
    and only substrings that are longer and still tie go on to the next key."""
    code = text * 2 + small + 1
    bits = (2 * size + 2).bit_length()
    width = 62 // bits
    length = np.append(np.diff(lms) + 1, 1)
    rank = np.zeros(len(lms), dtype=np.int64)  # place of the first of those that tie
    active, offset = np.arange(len(lms)), 0
    while len(active):
        key = np.zeros(len(active), dtype=np.int64)
        for nth in range(offset, offset + width):
            inside = length[active] > nth
            key = key << bits | np.where(inside, code[np.minimum(lms[active] + nth, len(code) - 1)], 0)
        order = np.lexsort((key, rank[active]))
        active, key, old = active[order], key[order], rank[active][order]
        at = np.arange(len(active))
        begins = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        fresh = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old + first - begins
        offset += width
        ties = np.bincount(first, minlength=len(active))[first] > 1
        active = active[ties & (length[active] > offset)]
    used = np.zeros(len(lms), dtype=np.int64)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank], int(used.sum())


def _sorted_suffixes(text: np.ndarray, size: int) -> np.ndarray:
    """``text`` ends in a 0 that occurs nowhere else; symbols are below ``size``."""
    if len(text) == 1:
        return np.zeros(1, dtype=np.int64)
    small = _smaller(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=size))
    if size <= FEW_SYMBOLS:
        rough = _induce_few(text, small, ends, lms)
        is_lms = np.zeros(len(text), dtype=bool)
        is_lms[lms] = True
        names, count = _names(text, lms, rough[is_lms[rough]])
    else:
        names, count = _names_of_many(text, small, lms, size)
    ordered = _sorted_suffixes(names, count) if count < len(lms) else np.argsort(names)
    return (_induce_few if size <= FEW_SYMBOLS else _induce_many)(text, small, ends, lms[ordered])


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of all suffixes of a sequence of bytes in ascending order (the sentinel's left out)."""
    text = np.append(data.astype(np.int16) + 1, 0).astype(np.int16)
    return _sorted_suffixes(text, 257)[1:]


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, breaks: np.ndarray, longest: int) -> np.ndarray:
    """For every place, how many bytes its suffix shares with the suffix before it in order, up to ``longest`` after the last break.

    Where the bytes before both suffixes agree, the value is that of the place
    before less one. The others, and the places in ``breaks``, are compared, eight bytes at a time.
    """
    count = len(data)
    if count == 0:
        return np.zeros(0, dtype=np.int64)
    previous = np.full(count, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(longest + 16, dtype=np.uint8)])
    words = np.ndarray((count + longest + 8,), dtype="<u8", buffer=padded, strides=(1,))
    fresh = np.ones(count, dtype=bool)
    place = np.arange(1, count)
    both = previous[1:] > 0
    fresh[1:] = ~both | (data[place - 1] != data[np.maximum(previous[1:], 1) - 1])
    fresh[breaks] = True
    shared = np.zeros(count, dtype=np.int64)
    live = np.flatnonzero(fresh & (previous >= 0))
    offset = 0
    while len(live) and offset < longest:
        differ = words[live + offset] ^ words[previous[live] + offset]
        equal = differ == 0
        ended, low = live[~equal], differ[~equal]
        lowest = low & (~low + np.uint64(1))  # its exponent tells the first byte that differs
        shared[ended] = offset + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        live = live[equal]
        offset += 8
    shared[live] = offset
    at = np.maximum.accumulate(np.where(fresh, np.arange(count), 0))
    return np.maximum(np.minimum(shared[at], count - np.maximum(at, previous[at])) - (np.arange(count) - at), 0)
