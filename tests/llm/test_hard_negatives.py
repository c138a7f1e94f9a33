"""Hard negatives: exact against brute force, bounds that hold, SQL on DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from leaselake.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, q string, norm int, angles int, slot int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "x", 1, 1, 1) for i, v, l in rows], SCHEMA)


def plain(rows):
    part = [(i, (l % 10 + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [p for p in part if sum(x * x for x in p[2]) <= 2**62]
    out = Counter()
    for a, label, q in part:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, r, strict=True)), i, l) for i, l, r in part if i != a and len(r) == len(q)), key=lambda x: x[:2])
        for p in [s for s in scored if s[2] == label][:5]:
            ps = -p[0]
            fits = [s for s in scored if s[2] != label and 80 * ps <= -100 * s[0] <= 100 * ps][:5]
            out.update((a, p[1], k + 1, s[1], ps, -s[0]) for k, s in enumerate(fits))
    return out


def found(df, **more):
    return Counter(tuple(r) for r in H.hard_negatives(df, **more).collect())


def clustered(seed, n, dim=12, centres=20, spread=0.15):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return [(n_, list(c[n_ % centres] + spread * r.normal(size=dim)), int(r.integers(0, 10))) for n_ in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_brute_force(spark, spread):
    rows = clustered(3, 900, spread=spread)
    assert found(table(spark, rows)) == plain(rows)
    assert found(table(spark, rows).repartition(5), block=2) == plain(rows)  # several blocks


def test_odd_rows(spark):
    rows = clustered(5, 260, dim=4)
    rows += [(None, [1, 2, 3, 4], 1), (300, None, 2), (301, [1, None, 0, 0], 3), (302, [1, float("nan"), 0, 0], 3), (303, [float("inf"), 0, 0, 0], 3), (304, [1, 1, 1, 1], None)]
    rows += [(400, [0, 0, 0, 0], 3), (401, [0, 0, 0, 0], 3), (402, [0, 0, 0, 0], 4), (500, [], 1), (501, [], 1), (502, [], 2), (600, [1, 2], 5), (601, [2, 1], 5), (602, [1.5, 1.5], 6)]
    rows += [(700, [1e30, 0, 0, 0], 1), (701, [9e6, 9e6, 0, 0], 1), (800, [3e6, 4e6, 1, 1], 1), (801, [3e6, 4e6, 1, 2], 1), (802, [3e6, 4e6, 1, 0], 2)]
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[100][1], 4), (37, rows[37][1], rows[37][2])]  # repeated ids
    rows += [(1000, rows[3][1], -3), (1001, rows[3][1], 2**31 - 1), (903, rows[3][1], 2**31 - 1), (1002, [-x for x in rows[3][1]], -3)]
    rows += [(2000 + n, rows[3][1], n % 2 + 1) for n in range(120)]  # ties
    assert found(table(spark, rows)) == plain(rows)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    rows = np.array([H.quantised(np.array(v)) for _, v, _ in clustered(7, 800, spread=0.05)] + [np.zeros(12)])
    rows[5] = -rows[4]
    norms = np.linalg.norm(rows, axis=1)
    for directions in (H.fitted_directions(list(rows[::3]), 16)[12], H.drawn_directions(12, 8, 2)):
        angles = H.angles_to(rows, norms, directions)
        low, high = H.score_bounds(norms, angles, (norms, norms), (angles, angles))
        scores = rows @ rows.T
        assert (low <= scores).all() and (scores <= high).all()
        groups = np.sort(r.permutation(len(rows)).reshape(-1, 9), axis=1)
        ends = [(x[groups].min(axis=1), x[groups].max(axis=1)) for x in (norms, angles)]
        low_g, high_g = H.score_bounds(norms, angles, *ends)
        assert all((low_g[:, g] <= scores[:, m].min(axis=1)).all() and (scores[:, m].max(axis=1) <= high_g[:, g]).all() for g, m in enumerate(groups))
    angles = H.angles_to(rows, norms, H.fitted_directions(list(rows[::3]), 16)[12])
    _, high = H.score_bounds(norms, angles, (norms, norms), (angles, angles))
    wanted = 0.8 * np.sort(scores, axis=1)[:, -6]
    assert (high < wanted[:, None]).mean() > 0.5  # most pairs of clustered rows need no scoring


def test_best_keeps_the_first_few():
    r = np.random.default_rng(2)
    keys, scores, ids = r.integers(0, 6, 500), r.integers(-3, 4, 500), r.permutation(500)
    best = H.Best(6, 4)
    for part in np.array_split(np.arange(500), 11):
        best.add(keys[part], scores[part], ids[part])
    want = [x for k in range(6) for x in sorted(((k, s, i) for kk, s, i in zip(keys, scores, ids, strict=True) if kk == k), key=lambda x: (-x[1], x[2]))[:4]]
    assert [tuple(x) for x in best.held] == want


def test_sql(spark, tmp_path):
    rows = clustered(11, 400, dim=6) + [(None, [1] * 6, 1), (500, None, 1), (700, [1, 2, 3, 4, 5, float("nan")], 1)]
    df = table(spark, rows)
    df.write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    want = Counter(con.execute(H.SQL).fetchall())
    assert want and found(df) == want


def test_empty(spark):
    assert H.hard_negatives(table(spark, [])).count() == 0
    assert H.hard_negatives(table(spark, [(1, [1.0], 1)])).count() == 0
    assert H.hard_negatives(table(spark, [(100, [1.0], 1), (200, [1.0], 2)])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
