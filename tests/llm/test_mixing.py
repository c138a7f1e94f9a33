"""Mixing: targets by hand, words taken near them, SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from llm_words import sentence

from leaselake.llm.mixing import SQL, expand_mix, mix_sources, source_targets

SCHEMA = "doc_id long, text string, source string, size int, target string, _id int, _copies int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x", 1, 1) for i, t, s in rows], SCHEMA)


def plain_targets(sizes, fraction=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    target, left = {}, fraction * sum(sizes.values())
    open_ = set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "": 70, "é": 300}, {"a": 0, "b": 0}, {"x": 9}, {"a": 100, "b": 100, "c": 100, "d": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark, rng):
    rows = [(n, sentence(rng, rng.choice([0, 1, 5, 40, 400])), rng.choice(["a", "a", "a", "b", None, ""])) for n in range(3000)]
    rows += [(None, "x y", "a"), (1, None, "b"), (7, "same words", "c"), (7, "same words", "c")]
    df = docs(spark, rows)
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    per = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        per.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        per[r["source"]][2] += r["taken"]
        per[r["source"]][3] += r["size"]
    sizes = {s: x[3] for s, x in per.items()}
    wanted = plain_targets(sizes)
    for s, (target, size, taken, own) in per.items():
        assert size == own and target == pytest.approx(wanted[s])
        assert abs(taken - target) <= 400 + 0.02 * target
    assert sorted(map(str, out)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))
    expanded = expand_mix(df.where("doc_id IS NOT NULL AND doc_id > 7"), mix_sources(df))
    assert expanded.columns == df.columns
    assert expanded.count() == sum(r["copies"] for r in out if r["doc_id"] and r["doc_id"] > 7)


def test_sql(spark, tmp_path, rng):
    rows = [(n, sentence(rng, rng.randrange(60)) or None, rng.choice(["a", "b", None, "Z", "é"])) for n in range(400)]
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(SQL).fetchall())
    got = sorted(tuple(r) for r in mix_sources(df).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert len(want) == len(got)
    assert all(a == pytest.approx(b) for a, b in zip(want, got, strict=True))


def test_empty(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    assert expand_mix(docs(spark, []), mix_sources(docs(spark, []))).count() == 0
