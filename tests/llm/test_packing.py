"""Packing: every document's ids come back, rows keep to their length."""

from __future__ import annotations

import numpy as np
import pytest
from llm_words import sentence

from leaselake.llm.packing import END_OF_TEXT, LONG_RUN, CapacityTree, best_fit_decreasing, encoder, pack_tokens, position_ids, token_ids, vocabulary_path, write_matrices


def plain_best_fit(sizes, top):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in left if x >= s]
        if fits:
            x = min(fits)
            left[left.index(x)] -= s
        else:
            left.append(top - s)
    return sorted(left)


def test_best_fit_decreasing(rng):
    for _ in range(60):
        top = rng.randrange(1, 70)
        sizes = [rng.randrange(1, top + 1) for _ in range(rng.randrange(60))]
        rows = best_fit_decreasing(sizes, top)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(top - sum(sizes[i] for i in r) for r in rows) == plain_best_fit(sizes, top)


def test_capacity_tree():
    tree = CapacityTree(10)
    assert tree.fit(1) is None
    for capacity, row in ((10, 1), (3, 2), (7, 3)):
        tree.add(capacity, row)
    assert [tree.fit(4), tree.fit(4), tree.fit(4), tree.fit(3)] == [(3, 7), (1, 10), None, (2, 3)]


@pytest.mark.parametrize("window", [50, 4_000_000])
def test_round_trip(spark, rng, window):
    texts = {1: None, 2: "", 3: "a", 4: sentence(rng, 900), 5: "<|endoftext|> ünï ☃", None: "no id", 6: sentence(rng, 20)}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()] + [(6, texts[6], 1, 2)], "doc_id long, text string, n_tokens int, _id int").coalesce(2)
    rows = pack_tokens(df, seq_len=64, window_tokens=window).collect()
    enc, found = encoder(vocabulary_path()), {}
    for r in rows:
        ids = np.frombuffer(r["token_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and r["position_resets"] == cu[:-1]
        assert (ids[cu[-1] :] == END_OF_TEXT).all()
        positions = position_ids(cu, 64)
        for k, (a, b) in enumerate(zip(cu, cu[1:])):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(r["doc_ids"][k], []).append((r["part_offsets"][k], r["doc_tokens"][k], ids[a:b].tolist()))
    assert len({r["bin_id"] for r in rows}) == len(rows)
    assert set(found) == set(texts)
    for doc, parts in found.items():
        whole = [*enc.encode_ordinary(texts[doc] or ""), END_OF_TEXT]
        copies = 2 if doc == 6 else 1
        assert sorted(parts) == sorted([(at, len(whole), whole[at : at + 64]) for at in range(0, len(whole), 64)] * copies)


def test_long_white_space_equals_the_whole_text():
    """Below what the pattern can take, ids are those of the whole text; the runs
    stand alone, in front, behind, and around every kind of piece."""
    enc = encoder(vocabulary_path())
    runs = [" " * LONG_RUN, " \n" * 1500, "\t" * 2500 + " ", " " * 2400 + "\n", "\u3000\xa0" * 1700, "\r\n" * 1200, " " * (LONG_RUN - 1), "\x1c" * 2500, "\x85 " * 3000]
    for run in runs:
        for text in (run, run + "a", "a" + run, f"a{run}b", f"don't{run}'s{run}7", f"..{run}!{run}", f"a {run} b\n{run}", run + "ü☃" + run + run):
            assert token_ids(enc, text) == enc.encode_ordinary(text), (run[:4], text[:9])


def test_very_long_texts(spark):
    n = 2_000_000
    texts = [" " * n, " \n" * (n // 2), "a" + " " * n, "\n" * n + "b", "x" * n, f"a{' ' * n}b{chr(9) * n}", "#" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found, enc = {}, encoder(vocabulary_path())
    for r in pack_tokens(df, seq_len=65_536).toLocalIterator():
        ids, cu = np.frombuffer(r["token_ids"], "<u2"), r["cu_seqlens"]
        for k, (a, b) in enumerate(zip(cu, cu[1:])):
            found.setdefault(r["doc_ids"][k], []).append((r["part_offsets"][k], ids[a:b]))
    assert len(found) == len(texts)
    for doc, parts in found.items():
        whole = np.concatenate([x for _, x in sorted(parts, key=lambda x: x[0])])
        assert whole[-1] == END_OF_TEXT and enc.decode(whole[:-1].tolist()) == texts[doc]


def test_empty_and_files(spark, tmp_path):
    schema = "doc_id long, text string"
    assert pack_tokens(spark.createDataFrame([], schema)).count() == 0
    write_matrices(pack_tokens(spark.createDataFrame([(1, "a b")], schema), seq_len=8), str(tmp_path / "m"))
    assert len(spark.read.parquet(str(tmp_path / "m")).first()["token_ids"]) == 16
