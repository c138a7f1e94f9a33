"""Repeated bytes against a set of all windows seen so far."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest

from leaselake.llm import suffix_dedup as D

SCHEMA = "doc_id long, text string, part int, n_bytes int, spans string"


def plain(docs, length):
    """docs in order: removed spans of each."""
    seen, out = set(), []
    for body in docs:
        gone = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - length + 1):
            w = body[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(int)))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def texts(rng, n=40, alphabet="abc é"):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 400))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(5)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            t += rng.choice([b[i:], b[:i], rng.choice("xyz") * rng.randrange(250), "".join(rng.choice("defgh") for _ in range(rng.randrange(200)))])
        out.append(t)
    return out


def check(spark, rows, length, order=None, **params):
    df = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    out = {r["doc_id"]: r for r in D.repeated_spans(df, length=length, **params).collect()}
    order = order or sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for (i, t), spans in zip(order, plain([(t or "").encode() for _, t in order], length), strict=True):
        r, body = out[i], (t or "").encode()
        assert [(s["start"], s["end"]) for s in r["spans"]] == spans, i
        kept = b"".join(body[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(body)]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    return df


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed, monkeypatch):
    rng = random.Random(seed)
    check(spark, list(enumerate(texts(rng))) + [(-5, None), (None, texts(rng)[0])], (10, 30, 100)[seed])


def local(docs, length, per_task=64, parts=3):
    """The operator's tasks one after the other, without Spark."""
    import pyarrow as pa

    keys = [(i, hash(x) & 0xFFFF) for i, x in enumerate(docs)]

    def by_part(batches):
        out = {}
        for b in batches:
            out.setdefault(b.column(0)[0].as_py(), []).append(b)
        return out

    def beside(q, found):
        for b in found:
            if b.column(0)[0].as_py() == q:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *b.columns, *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary())], names=["kind", *D.PACKED, "id", "t1", "t2", "utf8"])
        mine = [k for k, (a, b) in enumerate(keys) if (a ^ b) % parts == q]
        n = len(mine)
        cells = [pa.array([1] * n, pa.int32()), pa.array([q] * n, pa.int32()), *[pa.nulls(n, pa.binary()) for _ in D.PACKED[1:]]]
        cells += [pa.array([keys[k][0] for k in mine], pa.int64()), pa.array([keys[k][0] for k in mine], pa.int64()), pa.array([keys[k][1] for k in mine], pa.int64()), pa.array([docs[k] for k in mine], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, names=["kind", *D.PACKED, "id", "t1", "t2", "utf8"])

    def cleared(batches):
        """Windows alone, without the covered stretches beside them."""
        for b in batches:
            for n in ("cdoc", "cstart", "cend"):
                b = b.set_column(D.PACKED.index(n), n, pa.array([b""], pa.binary()))
            yield b

    runs = []
    for half in (slice(0, None, 2), slice(1, None, 2)):
        batch = pa.record_batch({"t1": pa.array([a for a, _ in keys[half]], pa.int64()), "t2": pa.array([b for _, b in keys[half]], pa.int64()), "body": pa.array(docs[half], pa.binary())})
        runs += D._run_records(length, parts, per_task)(iter([batch]))
    found = [b for mine in by_part(runs).values() for b in D._match_runs(parts)(iter(mine))]
    opened = [b for q in range(parts) for b in D._open_runs(length, parts)(beside(q, found))]
    opened += cleared(found)
    found += [b for mine in by_part(opened).values() for b in D._match_factors(length, parts)(iter(mine))]
    return {r["_id"]: r for q in range(parts) for b in D._finish(beside(q, found)) for r in b.to_pylist()}


@pytest.mark.parametrize("seed", range(25))
def test_tasks_with_small_bounds(seed, monkeypatch):
    rng = random.Random(seed)
    length = rng.choice([10, 30, 100])
    for name, values in {"PIECE": [512, 1 << 20], "RUNS_PER_ANCHOR": [1, 500], "WINDOWS_AT_ONCE": [50, 200_000], "WINDOW_BYTES": [200, 1 << 26], "OPEN_BYTES": [300, 1 << 24], "WIDE_BYTES": [250, 1 << 20]}.items():
        monkeypatch.setattr(D, name, rng.choice(values))
    monkeypatch.setattr(D, "_POWERS", {})
    docs = [t.encode() for t in texts(rng, 30, "abc \x00")]
    out = local(docs, length, rng.choice([1, 64]))
    for k, spans in enumerate(plain(docs, length)):
        assert [(s["start"], s["end"]) for s in out[k]["spans"]] == spans


def test_periodic_and_equal_texts(spark):
    rows = [(1, "a" * 350), (2, "ab" * 200), (3, "a" * 350), (4, "x" + "ab" * 60), (5, "é" * 99), (6, "ab" * 200 + "c")]
    check(spark, rows, 100)


def test_repeated_rows(spark):
    body = "".join(random.Random(1).choices("abcdef", k=300))
    df = spark.createDataFrame([(2, body, 0, 0, "x"), (2, body, 0, 0, "x"), (3, body[:200], 0, 0, "x")], SCHEMA)
    assert sorted((r["doc_id"], r["n_removed"]) for r in D.repeated_spans(df).collect()) == [(2, 0), (2, 0), (3, 200)]
    kept = {(r["doc_id"], bytes(r["kept"])) for r in D.without_repeats(df.dropDuplicates()).collect()}
    assert kept == {(2, body.encode()), (3, b"")}


def test_sql(spark, tmp_path):
    rows = list(enumerate(texts(random.Random(8)))) + [(70, None), (71, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sorted(tuple(r) for r in D.repeated_spans(df).drop("spans").collect())
    assert sorted(con.execute(D.SQL).fetchall()) == got


def test_empty(spark):
    assert D.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_anchor_is_spread(monkeypatch):
    """A short passage in every document, contexts differing: no bucket of anchors
    or windows gets much more than the others, and nothing is removed."""
    import pyarrow as pa

    rng, parts = random.Random(3), 16
    passage = "".join(rng.choices("abcdefgh", k=90))
    docs = ["".join(rng.choices("ijklmnop", k=300)) + passage + "".join(rng.choices("ijklmnop", k=300)) for _ in range(1500)]
    batch = pa.record_batch({"t1": pa.array(range(1500), pa.int64()), "t2": pa.array([0] * 1500, pa.int64()), "utf8": pa.array([d.encode() for d in docs], pa.binary())})
    out = list(D._run_records(100, parts, D.RUNS_PER_TASK)(iter([batch])))
    for column in ("anchor", "w1"):
        sizes = [sum(len(b.column(D.PACKED.index(column))[0].as_py()) // 8 for b in out if b.column(0)[0].as_py() == q) for q in range(parts)]
        assert min(sizes) > 0 and max(sizes) < 1.5 * np.median(sizes), column
    found = local([d.encode() for d in docs[:300]], 100)
    assert all(r["spans"] == [] for r in found.values())
