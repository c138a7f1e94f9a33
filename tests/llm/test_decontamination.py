"""Decontamination against Smith-Waterman over whole texts, without seeds."""

from __future__ import annotations

import numpy as np
import pytest
from llm_words import sentence

from leaselake.llm.decontamination import Items, align, decontaminate, drop_contaminated, flagged_passages, seed_length, seeds_needed, words_of

SCHEMA = "doc_id long, text string, item_id int, _gone int"


def plain_score(item, text):
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (1 if a == b else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_align(rng):
    for _ in range(30):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
        texts = [[rng.randrange(0, 5) for _ in range(rng.randrange(1, 20))] for _ in range(5)]
        block = np.full((5, 20), -1)
        for row, t in zip(block, texts, strict=True):
            row[: len(t)] = t
        assert align(np.array(item), block)[0].tolist() == [plain_score(item, t) for t in texts]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        what = rng.random()
        if what < 0.4:
            words[at] = f"new{rng.randrange(99)}"
        elif what < 0.7:
            words.insert(at, f"new{rng.randrange(99)}")
        elif len(words) > 1:
            del words[at]
    return words


def test_seeds_lose_nothing(rng):
    items = [(n, sentence(rng, size, 60)) for n, size in enumerate([1, 2, 3, 4, 5, 6, 9, 10, 14, 25, 40])]
    block = Items(items, 0.8)
    texts = []
    for _, item in items:
        words = item.split()
        for edits in range(len(words) // 4 + 2):
            texts.append(" ".join([sentence(rng, 30, 60), *edited(rng, words, edits), sentence(rng, 30, 60)]))
    frequency = {}
    for n, grams in block.grams.items():
        for t in texts:
            for g in set(block.hits(block.numbers(t), n, grams)[1].tolist()):
                frequency[n, int(grams[g])] = frequency.get((n, int(grams[g])), 0) + 1
    sizes = {n for n, _ in frequency}
    block.choose({n: tuple(np.array(x) for x in zip(*sorted((g, c) for (m, g), c in frequency.items() if m == n), strict=True)) for n in sizes})
    got = {(k, i) for k, i, *_ in flagged_passages(block, texts)}
    want = {(k, n) for n, item in items for k, t in enumerate(texts) if 10 * (len(words_of(item)) + plain_score(words_of(item), words_of(t))) >= 16 * len(words_of(item))}
    assert got == want and len(want) > 20


def test_seed_rule():
    for words in range(2, 300):
        n = seed_length(words, 0.8)
        assert n == 1 or seeds_needed(words, n, 0.8) <= words - n + 1
    assert seed_length(40, 0.8) == 3


@pytest.mark.parametrize("block_chars", [60, 4_000_000])
def test_documents(spark, rng, block_chars):
    items = [sentence(rng, 30) for _ in range(4)]
    near = items[1].split()
    near[3], near[20] = "changed", "too"
    rows = [(1, sentence(rng, 200)), (2, f"Intro. {items[0].upper()}! {sentence(rng, 50)}"), (3, " ".join([sentence(rng, 90), *near])), (4, None), (5, ""), (6, items[2][: len(items[2]) // 3]), (None, items[3]), (7, f"{items[0]} {items[3]}"), (8, "x"), (8, items[0])]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ?! "), (None, items[0])], "item_id long, text string")
    found = {(r["doc_id"], r["contaminated"], r["item_id"], r["n_items"]) for r in decontaminate(df, bench, block_chars=block_chars).collect()}
    assert found == {(1, False, None, 0), (2, True, 0, 2), (3, True, 1, 1), (4, False, None, 0), (5, False, None, 0), (6, False, None, 0), (None, True, 3, 1), (7, True, 0, 3), (8, True, 0, 2)}
    kept = drop_contaminated(df, bench, block_chars=block_chars)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c", 0, 0)], SCHEMA)
    assert [tuple(r) for r in decontaminate(some, bench.limit(0)).collect()] == [(1, False, None, None, 0)]
    assert drop_contaminated(some, bench.limit(0)).count() == 1


def test_items_without_id_and_long_texts(spark, rng):
    items = [sentence(rng, 30) for _ in range(3)]
    long = " ".join(f"w{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, items[0], 0, 0), (2, f"{long} {items[1]} {long}", 0, 0), (3, long, 0, 0)], SCHEMA)
    bench = spark.createDataFrame([(None, items[0]), (7, items[1]), (None, items[2])], "item_id long, text string")
    found = {(r["doc_id"], r["contaminated"], r["item_id"], r["similarity"], r["n_items"]) for r in decontaminate(df, bench).collect()}
    assert found == {(1, True, None, 1.0, 1), (2, True, 7, 1.0, 1), (3, False, None, None, 0)}
    assert [r["doc_id"] for r in drop_contaminated(df, bench).collect()] == [3]
