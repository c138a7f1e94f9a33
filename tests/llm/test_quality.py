"""Quality ledger: measures by hand and by brute force, policies, ablations, SQL."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from llm_words import sentence

from leaselake.llm import quality as Q

SCHEMA = "doc_id long, text string, n_words int, failed string, _m int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], SCHEMA)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)),
        sum(any(c.isalpha() for c in w) for w in words), len(covered),
    )


def measured(spark, texts):
    rows = Q.quality_ledger(docs(spark, list(enumerate(texts)))).collect()
    return {r["doc_id"]: tuple(r[c] for c in Q.MEASURES) for r in rows}


def test_measures(spark, rng):
    some = sentence(rng, 12)
    texts = [
        None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 8, "x " * 9, "x " * 30, f"{some} and {some}", f"{some}\n{some}\n\n{some} ",
        "é ü 日本 🎉 ## <b> | 12 3.4", "l\nl\n l\n\n\r\nl\r\n", " ".join(sentence(rng, 3, 3) for _ in range(40)), "a\x0bb\x0cc d e",
    ]
    texts += ["\n".join(sentence(rng, rng.randrange(12), 6) for _ in range(rng.randrange(20))) for _ in range(60)]
    assert measured(spark, texts) == {n: plain(t) for n, t in enumerate(texts)}


def test_very_long_texts(spark, rng):
    texts = [sentence(rng, 100_000, 50), "word " * 300_000, "x" * 2_000_000, "#" * 2_000_000, " " * 2_000_000, "l\n" * 200_000]
    assert measured(spark, texts) == {n: plain(t) for n, t in enumerate(texts)}


def test_policies_and_ablations(spark, rng):
    clean = sentence(rng, 60)
    rows = [(1, clean), (2, "short"), (3, clean + " ###" * 9), (4, "a b c d e f g h " * 9), (5, "## " * 40), (None, clean), (1, clean)]
    ledger = Q.quality_ledger(docs(spark, rows)).cache()
    kept = {v: Counter((r["doc_id"], r["kept"]) for r in Q.apply_policy(ledger, p).collect()) for v, p in Q.POLICIES.items()}
    good = Counter({(1, True): 2, (None, True): 1, (2, False): 1, (4, False): 1, (5, False): 1})
    assert kept["base"] == good + Counter([(3, True)])
    assert kept["1"] == kept["2"] == good + Counter([(3, False)])
    base = {r["doc_id"]: r["base_failed"] for r in Q.apply_policy(ledger, Q.POLICIES["2"]).collect()}
    assert base == {1: False, None: False, 2: True, 3: False, 4: True, 5: True}
    found = {r["rule"]: r for r in Q.ablations(ledger, Q.POLICIES["2"]).collect()}
    failed = [{r.name for n, r in enumerate(Q.RULES) if f >> n & 1} for f in (x["failed"] for x in ledger.collect())]
    words = [x["n_words"] for x in ledger.collect()]
    for rule in (r.name for r in Q.RULES):
        assert found[rule]["n_failed"] == sum(rule in f for f in failed)
        assert found[rule]["n_alone"] == sum(f == {rule} for f in failed)
        assert found[rule]["words_alone"] == sum(w for f, w in zip(failed, words, strict=True) if f == {rule})
    assert sum(r["n_first"] for r in found.values()) == sum(bool(f) for f in failed)
    assert set(r["rule"] for r in Q.ablations(ledger, Q.BASE).collect()) == {"few_words", "repeated_words"}
    with pytest.raises(ValueError):
        Q.quality_ledger(docs(spark, rows), rules=Q.RULES * 10)


def test_sql(spark, tmp_path, rng):
    rows = [(n, "\n".join(sentence(rng, rng.randrange(30), 5) for _ in range(rng.randrange(6))) or None) for n in range(200)]
    rows += [(None, sentence(rng, 50)), (3, "a b"), (3, "a b"), (900, "#é ## a|b")]
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(con.execute(Q.SQL).fetchall(), key=key)
    names = [d[0] for d in con.execute(Q.SQL).description]
    out = Q.apply_policy(Q.quality_ledger(df), Q.POLICIES["2"]).select(*names)
    assert sorted((tuple(r) for r in out.collect()), key=key) == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    empty = Q.quality_ledger(docs(spark, []))
    assert Q.apply_policy(empty, Q.BASE).count() == 0 and Q.ablations(empty, Q.BASE).count() == 0
