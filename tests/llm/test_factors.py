"""Longest previous factors against a comparison of all pairs of suffixes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from leaselake.llm.factors import longest_previous_factors, packed_bytes, suffix_order


def plain(strings):
    out = []
    for i, s in enumerate(strings):
        best = 0
        for t in strings[:i]:
            k = next((k for k, (a, b) in enumerate(zip(s, t)) if a != b), min(len(s), len(t)))
            best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_against_all_pairs(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 90))) * rng.choice([1, 2])
    cuts = [0, *sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randrange(4)))), len(text)]
    suffixes = [(p, b) for a, b in zip(cuts, cuts[1:]) for p in range(a, b)]
    if seed % 2:
        rng.shuffle(suffixes)
    at, ends = np.array(suffixes).T
    strings, packed = [text[a:b] for a, b in suffixes], packed_bytes(np.frombuffer(text, np.uint8))
    order, lcp = suffix_order(packed, at, ends)
    assert [strings[i] for i in order] == sorted(strings)
    assert lcp[1:].tolist() == [plain([strings[j], strings[i]])[1] for j, i in zip(order, order[1:])]
    for least in (1, 5):
        assert longest_previous_factors(packed, at, ends, least).tolist() == [x if x >= least else 0 for x in plain(strings)]


def test_nothing():
    none = np.zeros(0, np.int64)
    assert len(longest_previous_factors(packed_bytes(np.zeros(0, np.uint8)), none, none)) == 0
