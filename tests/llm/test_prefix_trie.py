"""Prefix trie: brute force over shards of several sizes, odd rows, SQL on DuckDB."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from llm_words import sentence

from leaselake.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, words int, shard int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], SCHEMA)


def said(rows):
    """Turns by conversation, in order; rows of equal number by their digest."""
    out = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            out[c].append(((n is not None, n or 0), digest, role, text))
    return {c: [(role, text) for _, _, role, text in sorted(x)] for c, x in out.items()}


def rebuilt(own):
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + own[c][h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += cost
    digest = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


def found(turns, **more):
    return Counter(tuple(r) for r in P.prefix_trie(turns, **more).select(COLUMNS).collect())


def corpus(rng, n=150):
    rows = []
    for c in range(n):
        length = rng.choice([1, 1, 2, 3, 4, 6])
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", sentence(rng, rng.randrange(4), 2)) for k in range(length)]
    rows += [(1000, 0, "user", "hot")] + [(c, 0, "user", "hot") for c in range(2000, 2150)]
    return rows


@pytest.mark.parametrize(("conversations", "held"), [(1024, 65_536), (7, 65_536), (5, 3), (1, 1)])
def test_brute_force(spark, rng, conversations, held):
    """Shards of few conversations and turns, so that nodes meet across shards and
    long conversations become chains."""
    rows = corpus(rng)
    numbered = P.numbered_turns(table(spark, rows))
    assert found(P.own_turns(numbered), conversations=conversations, held=held) == plain(said(rows))
    assert found(P.rebuilt_turns(numbered), conversations=conversations, held=held) == plain(rebuilt(said(rows)))


def test_odd_rows(spark, rng):
    rows = [
        (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "c"), (2, 5, "", ""), (2, -1, None, "x"), (None, 0, "user", "lost"),
        (-7, 0, "user", "neg"), (-7, 1, "user", "neg"), (-20, 0, "user", "base"), (40, 0, "user", "1:" + "y"), (41, 0, "user1", ":y"), (42, 0, "user", "z " * 400_000), (43, 0, "é", "日本 \x0b x"),
        (9, 9, "user", "only"), (29, 0, "user", "t"), (2**63 - 1, 0, "u", "v"), (-(2**63), 0, "u", "v"),
    ]
    numbered = P.numbered_turns(table(spark, rows))
    assert found(P.rebuilt_turns(numbered)) == plain(rebuilt(said(rows)))
    assert found(P.own_turns(numbered), conversations=2, held=2) == plain(said(rows))


def test_long_conversation(spark):
    rows = [(7, n, "user", f"w {n % 5}") for n in range(5000)] + [(8, n, "user", f"w {n % 5}") for n in range(4000)]
    turns = P.own_turns(P.numbered_turns(table(spark, rows)))
    for held in (65_536, 100):
        out = P.prefix_trie(turns, held=held)
        assert out.count() == 5001
        top = out.where("depth = 0").first()
        assert (top["n_convs"], top["n_leaves"], top["saved_tokens"]) == (2, 1, 8000)
        assert out.where("depth = 4000").first()["n_children"] == 1


def test_sql(spark, tmp_path, rng):
    rows = corpus(rng, 90) + [(None, 0, "u", "x"), (3, 0, "user", None), (3, None, None, "y z"), (-41, 2, "u", "é")]
    df = table(spark, rows)
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = Counter(con.execute(P.SQL).fetchall())
    assert found(P.rebuilt_turns(P.numbered_turns(df))) == want == plain(rebuilt(said(rows)))


def test_empty(spark):
    numbered = P.numbered_turns(table(spark, []))
    assert P.prefix_trie(P.rebuilt_turns(numbered)).select(COLUMNS).count() == 0
