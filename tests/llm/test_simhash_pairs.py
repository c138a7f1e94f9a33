"""Near-duplicates by similarity against a plain comparison of all pairs of sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from llm_words import sentence
from shared_rows import rows_of

from leaselake.llm.simhash_pairs import _proposals, error_budget, keep_one_similar, near_leaves, share_apart, similar_components, table_bits

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= threshold * len(x | y):
                a, b = label[i], label[j]
                label = [min(a, b) if c in (a, b) else c for c in label]
    return label


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    passage = sentence(rng, 40)
    texts = [None, "", "  ", "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = sentence(rng, rng.choice((8, 60, 200, 400)))
        texts += [base] + [edited(rng, base, rng.randrange(10)) for _ in range(4)]
    texts += [f"{sentence(rng, rng.choice((3, 8, 60)))} {passage}" for _ in range(20)]
    dense = sentence(rng, 150)
    texts += [edited(rng, dense, 2) for _ in range(40)]
    texts.append(" ".join(f"w{i}" for i in range(20_000)))
    texts.append(texts[-1] + " end")
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("limit", [4096, 20])
def test_all_pairs(spark, rng, limit):
    """Also where every bucket is dealt out as pairs of parts."""
    texts = corpus(rng)
    wanted = plain_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert len({*wanted}) < len(texts) - 50
    found = dict(rows_of(similar_components(df, bucket_limit=limit, miss=1e-4), "doc_id", "component_id"))
    sets = [shingles(t) for t in texts]
    for i, c in found.items():  # never linked to what no chain of links reaches
        assert wanted[i] == wanted[c], (i, c)
    right = sum(found[i] == w for i, w in enumerate(wanted))
    assert right >= 0.97 * len(texts), right
    # one edit or two in some hundred words are always found
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.9 * len(x | sets[j]):
                assert found[i] == found[j]


def test_stage_drops_near_copies(spark, rng):
    texts = corpus(rng)[:60]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA + ", _id string, node int")
    kept = keep_one_similar(df, miss=1e-4)
    assert kept.columns == df.columns
    assert {*plain_components(texts)} <= {r[0] for r in kept.select("doc_id").collect()}
    assert kept.count() <= len({*plain_components(texts)}) + 2


def test_trie_finds_what_all_pairs_find(rng):
    n = 300
    base = [rng.getrandbits(64) for _ in range(60)]
    bits = np.array([base[i % 60] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12))) for i in range(n)], np.uint64)
    order = np.argsort(bits)
    c = {"trie": bits[order], "hi": bits[order], "lo": np.zeros(n, np.uint64), "size": np.full(n, 9), "label": np.arange(n) % 7}
    for budget in (3, 10):
        found = {(int(a), int(b)) for i, j in near_leaves(c, np.array([0, 200]), np.array([200, n]), 0.8, budget) for a, b in zip(i, j, strict=True)}
        wanted = {
            (i, j)
            for j in range(n)
            for i in range(j)
            if (i < 200) == (j < 200) and i % 7 != j % 7 and (int(c["hi"][i]) ^ int(c["hi"][j])).bit_count() <= budget
        }
        assert found == wanted and wanted


def test_proposals_grow_to_all(rng):
    """The nearest ones and a mark that there are more; then all of them."""
    n, base = 12, rng.getrandbits(63)
    flips = [sum(1 << b for b in rng.sample(range(63), x)) for x in range(n)]
    cells = {"node": range(n), "label": range(n), "members": [1] * n, "size": [9] * n, "hi": [base ^ f for f in flips], "lo": [7] * n}
    batch = pa.record_batch({k: pa.array(list(v), pa.int64()) for k, v in (cells | dict.fromkeys(("t", "key", "p", "q", "own"), [0] * n)).items()})

    def found(width):
        return {(u, v) for b in _proposals(0.8, width)(iter([batch])) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)}

    far = {(i, j): (flips[i] ^ flips[j]).bit_count() for j in range(n) for i in range(j)}
    assert found(None) == found(n) == {x for x, d in far.items() if d <= error_budget(0.8)}
    for i in range(n - 1):
        near = sorted(d for (a, _), d in far.items() if a == i and d <= error_budget(0.8))
        given = {v for u, v in found(3) if u == i}
        assert sorted(far[i, v] for v in given - {i}) == near[:3]  # of equally near ones any
        assert (i in given) == (len(near) > 3)


def test_refused_neighbours_do_not_hide_a_link(spark, rng):
    """A dense group whose pairs are nearly all just below the threshold: one proposal
    a table fails for most documents, and the last round confirms or refuses the rest.
    All pairs whose fingerprints are in reach are linked as by a search for all pairs."""
    base = sentence(rng, 120)
    texts = [edited(rng, base, 2 + i % 5) for i in range(80)]
    sets = [shingles(t) for t in texts]
    wanted = plain_components(texts)
    linked = sum(len(x & y) >= 0.8 * len(x | y) for j, x in enumerate(sets) for y in sets[:j])
    assert 0 < linked < 0.9 * 80 * 79 / 2
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for widths in ((1, None), (None,)):
        found = dict(rows_of(similar_components(df, miss=1e-6, widths=widths), "doc_id", "component_id"))
        assert sum(found[i] != w for i, w in enumerate(wanted)) <= 1


def test_heavy_groups_are_cut(spark, rng, monkeypatch):
    """Groups with too many shingles or pairs for a task give the same links."""
    from leaselake.llm import simhash_pairs

    df = spark.createDataFrame(list(enumerate(corpus(rng))), SCHEMA)
    whole = rows_of(similar_components(df), "doc_id", "component_id")
    monkeypatch.setattr(simhash_pairs, "SHINGLES_KEPT", 500)
    monkeypatch.setattr(simhash_pairs, "PAIRS_TOGETHER", 3)
    assert rows_of(similar_components(df), "doc_id", "component_id") == whole


def test_tables_cover_the_threshold():
    """Tables miss a pair at 0.8 with the wanted probability, at any size."""
    for n in (1000, 10**6, 10**9):
        tables = table_bits(n)
        assert all(len(set(t)) == len(t) for t in tables)
        assert (1 - (1 - share_apart(0.8)) ** len(tables[0])) ** len(tables) < 0.01
    assert 19 < 128 * share_apart(0.8) < 20 and error_budget(0.8) == 29


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (2, "a b"), (1, "a b"), (None, None)], SCHEMA)
    assert rows_of(keep_one_similar(df)) == [(None, None), (None, "a b"), (1, "a b")]
    assert keep_one_similar(df.limit(0)).count() == 0
