"""Suffix order and longest-previous-factor arrays of many byte strings, in numpy.

Suffix ``i`` is ``content[at[i]:ends[i]]``, where content is given as
``packed_bytes(content)``; a smaller ``i`` is an earlier one. Its
longest previous factor is the length of its longest prefix that is also the
prefix of an earlier suffix. In suffix order the candidates are two: the nearest
suffix before it, and the nearest after it, that are earlier (the previous and the
next smaller position); every other earlier suffix shares less with it.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a suffix that are compared in one step, beside a count of those left.
STEP = 7


def packed_bytes(content: np.ndarray) -> np.ndarray:
    """At each place the next ``STEP`` bytes as one number (zeros behind the end)."""
    padded = np.zeros(len(content) + STEP, np.uint8)
    padded[: len(content)] = content
    out = np.zeros(len(content), np.uint64)
    for k in range(STEP):  # in place: this is the largest array of its task
        np.left_shift(out, np.uint64(8), out=out)
        np.bitwise_or(out, padded[k : k + len(content)], out=out)
    return out


def _words(packed: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next ``STEP`` bytes of suffixes and how many they still have, as one
    number that sorts as the bytes do, the end of a suffix before any byte."""
    have = np.clip(left, 0, STEP)
    word = packed[np.minimum(at, len(packed) - 1)]
    short = have < STEP
    if short.any():
        word = np.where(short, word & ~(np.uint64((1 << 8 * STEP) - 1) >> (8 * have).astype(np.uint64)), word)
    return word << np.uint64(8) | have.astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that two words have in common from the left."""
    differ = (a ^ b) >> np.uint64(8)
    bits = np.frexp(differ.astype(np.float64))[1]  # exact below 2**53; above, see next line
    high = differ >> np.uint64(48)
    bits = np.where(high > 0, 48 + np.frexp(high.astype(np.float64))[1], bits)
    counts = np.minimum(a & np.uint64(255), b & np.uint64(255)).astype(np.int64)
    return np.minimum((8 * STEP - bits) // 8, counts)


def suffix_order(packed: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes from least to greatest, equal ones by number, and the
    bytes that each shares with the one before it in this order."""
    n = len(at)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    lo = np.zeros(1 if n else 0, np.int64)  # groups that are equal so far: [lo, hi) of order
    hi = np.full(len(lo), n)
    depth = 0
    while len(lo):
        many = hi - lo
        group = np.repeat(np.arange(len(lo)), many)
        place = np.arange(len(group)) + np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)
        mine = order[place]
        word = _words(packed, at[mine] + depth, ends[mine] - at[mine] - depth)
        step = np.lexsort((word, group)) if len(lo) > 1 else np.argsort(word, kind="stable")
        mine, word = mine[step], word[step]
        order[place] = mine
        inner = group[1:] == group[:-1]
        same = inner & (word[1:] == word[:-1])
        lcp[place[1:][inner]] = depth + _shared(word[1:][inner], word[:-1][inner])
        # a group goes on while its words are equal and full
        going = np.r_[same & (word[1:] & np.uint64(255) == STEP), False]
        first = going & ~np.r_[False, going[:-1]]
        last = going & ~np.r_[going[1:], False]
        lo, hi = place[first], place[np.flatnonzero(last) + 1] + 1
        depth += STEP
    return order, lcp


def _nearest_smaller(value: np.ndarray, lcp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to its left of smaller ``value`` (-1: none
    within ``widest``) and the least ``lcp`` from behind that one up to it. Minima
    of blocks of 1, 2, 4, ... places are kept, and larger blocks skipped first."""
    n = len(value)
    low, least = [value], [lcp]
    while 1 << len(low) <= min(widest, n):
        half = 1 << len(low) - 1
        v, c = low[-1].copy(), least[-1].copy()
        v[half:] = np.minimum(v[half:], low[-1][:-half])
        c[half:] = np.minimum(c[half:], least[-1][:-half])
        low.append(v)
        least.append(c)
    at, shared = np.arange(n) - 1, lcp.copy()
    for k in range(len(low) - 1, -1, -1):
        size = 1 << k
        skip = (at >= size - 1) & (low[k][np.maximum(at, 0)] > value)
        shared = np.where(skip, np.minimum(shared, least[k][np.maximum(at, 0)]), shared)
        at = np.where(skip, at - size, at)
    found = (at >= 0) & (value[np.maximum(at, 0)] < value)
    return np.where(found, at, -1), np.where(found, shared, 0)


def longest_previous_factors(packed: np.ndarray, at: np.ndarray, ends: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix; those below ``least`` are 0."""
    order, lcp = suffix_order(packed, at, ends)
    out = np.zeros(len(at), np.int64)
    # only stretches of the order whose neighbours share enough can reach `least`
    near = lcp >= max(1, least)
    near[:1] = False
    keep = near | np.r_[near[1:], False]
    order, lcp = order[keep], np.where(near, lcp, 0)[keep]
    if not len(order):
        return out
    starts = np.flatnonzero(lcp == 0)
    widest = int(np.diff(np.r_[starts, len(order)]).max())
    _, left = _nearest_smaller(order, lcp, widest)
    turned = np.r_[0, lcp[:0:-1]]
    _, right = _nearest_smaller(order[::-1].copy(), turned, widest)
    out[order] = np.maximum(left, right[::-1])
    out[out < least] = 0
    return out
