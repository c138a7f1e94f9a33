"""Embedding links against all cosines: recall, exact counts, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaselake.llm import embedding_dedup
from leaselake.llm.embedding_dedup import embedding_links, encode, hamming_budget, learn_projection, learn_rotation, links_within, near_codes, table_masks

SCHEMA = "vec_id long, embedding array<float>, label int, size int, links long"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def family(rng, n=300, dim=32, copies=6, noise=0.3):
    base = rng.normal(size=(n, dim))
    many = np.repeat(base, rng.integers(1, copies, n), axis=0)
    return (many + noise * rng.normal(size=many.shape) * rng.random((len(many), 1))).astype(np.float32)


def plain(x, threshold=0.9):
    near = unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(near, label[None, :], len(x)).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    return near.sum(axis=1), label


def check_against_plain(spark, x, **params):
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)], SCHEMA)
    out = sorted(embedding_links(df, **params).collect(), key=lambda r: r["vec_id"])
    links, label = plain(x)
    got = np.array([r["n_links"] for r in out])
    assert len(out) == len(x) and (got <= links).all()
    assert got.sum() >= 0.9 * links.sum()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    same = np.mean([r["component_id"] == c for r, c in zip(out, label, strict=True)])
    assert same >= 0.9
    return got, links


def test_recall(spark):
    check_against_plain(spark, family(np.random.default_rng(1)))


def test_close_copies_are_all_found(spark):
    got, links = check_against_plain(spark, family(np.random.default_rng(2), noise=0.03))
    assert (got == links).all() and links.sum() > 300


def test_blocks_of_a_crowded_bucket(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(1, 16)) + 0.02 * rng.normal(size=(120, 16))).astype(np.float32)
    got, links = check_against_plain(spark, x, block=7)
    assert (got == links).all() and (links == 119).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (10, [1.0, 2.0, 0.0]), (11, [-1.0, -2.0]), (None, [1.0, 2.0]), (12, [3e38, 3e38]), (13, [1e-38, 1e-38]), (13, [1e-38, 1e-38])]
    out = embedding_links(spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)).collect()
    found = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in out))
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    wanted = [(0, 5, 1, False), (1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), *alone]
    # [1, 2] and [1, 1] meet at cosine 0.949
    wanted = [(a, 6 if a < 4 else b, c, d) for a, b, c, d in wanted] + [(12, 6, 1, False), (13, 6, 1, False), (13, 6, 1, False)]
    assert found == wanted


def test_empty(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embedding_links(spark.createDataFrame([(1, None, 0, 0, 0)], SCHEMA)).collect()[0]["n_links"] == 0


def test_pairs_count_once():
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(30, 8)))
    ids, rows = np.arange(30), np.arange(30)
    codes = rng.integers(0, 4, (30, 1)).astype(np.uint64)
    sizes = np.ones(30, np.int64)
    total = np.zeros(30, np.int64)
    for t, mask in enumerate(masks := [(1,), (2,), (0,)]):
        for key in np.unique(codes & np.uint64(mask[0])):
            mine = rows[(codes & np.uint64(mask[0]) == key)[:, 0]]
            c, _, n = links_within(ids, codes, x, sizes, mine, mine, masks[:t], 0.9, step=4)
            np.add.at(total, c, n)
    assert (total == 29).all()


def test_codes_are_balanced():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(2000, 24)) * np.linspace(0.2, 2, 24))
    codes = encode(x, learn_rotation(x, 64))
    share = [(codes[:, 0] >> np.uint64(b) & np.uint64(1)).mean() for b in range(24)]
    assert 0.35 < min(share) and max(share) < 0.65
    masks = table_masks(10**9, 128, 0.9)
    assert len(set(masks)) == len(masks) and all(sum(x.bit_count() for x in m) == 21 for m in masks)


def planted_recall(n, dim, pairs=4000, low=0.9, high=0.93):
    """Share of planted pairs that meet in a table of an index for n vectors and
    are within the Hamming budget."""
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(pairs, dim)))
    away = rng.normal(size=(pairs, dim))
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(low, high, (pairs, 1))
    y = c * x + np.sqrt(1 - c * c) * away
    projection = learn_projection(x[:2000], 128)
    differ = encode(x, projection) ^ encode(y, projection)
    met = np.any([(differ & np.array(m, np.uint64) == 0).all(axis=1) for m in table_masks(n, 128, 0.9)], axis=0)
    return (met & (np.bitwise_count(differ).sum(axis=1) <= hamming_budget(128, 0.9))).mean()


@pytest.mark.parametrize(("n", "bits"), [(10**5, 8), (10**7, 15), (10**9, 21)])
def test_recall_at_any_size(n, bits):
    """Also at the long substrings of large tables, which no test table reaches."""
    assert sum(x.bit_count() for x in table_masks(n, 128, 0.9)[0]) == bits
    assert planted_recall(n, 64) >= 0.95


@pytest.mark.parametrize("dim", [8, 16, 32])
def test_recall_of_short_vectors(dim):
    assert planted_recall(10**5, dim) >= 0.9


def test_classes_are_equal_vectors_not_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_hash", lambda v: F.lit(7).cast("long"))
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)]
    out = embedding_links(spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 0, 4)]


def test_near_codes():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 6, (90, 2)).astype(np.uint64)
    for left, right in ((np.arange(90),) * 2, (np.arange(50), np.arange(50, 90))):
        wanted = np.zeros(90, bool)
        for i in left:
            for j in right:
                if i != j and sum(int(x).bit_count() for x in codes[i] ^ codes[j]) <= 2:
                    wanted[[i, j]] = True
        assert (near_codes(codes, left, right, 2, step=16) == wanted).all()
