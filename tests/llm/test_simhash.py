"""SimHash against a plain count of bits and a plain search of all pairs."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from shared_rows import rows_of

from leaselake.llm.components import connected_components
from leaselake.llm.simhash import fingerprint, forest, keep_one_per_component, simhash_components, table_masks, trie_links

SCHEMA = "doc_id long, text string, fp long, component_id string, _gone int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, budget=4):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_fingerprint(rng):
    from llm_words import sentence

    texts = [None, "", " \t\x0b", "One", "A b C d", "ÄB äb Äb x y z", "a\x85b c d e"] + [sentence(rng, n) for n in (1, 3, 4, 5, 50, 333)]
    assert [fingerprint(t) & (1 << 64) - 1 for t in texts] == [plain_fingerprint(t) for t in texts]


def family(rng, n=150):
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randrange(5)):
            for b in rng.sample(range(64), rng.randrange(7)):
                base ^= 1 << b
            out.add(base)
    return sorted(out)


def test_forest_connects_what_pairs_connect(rng):
    fps = family(rng)
    place = {f: i for i, f in enumerate(fps)}
    array = np.array(fps, np.uint64)
    for masks in ([0], table_masks(4)):
        label = list(range(len(fps)))
        links = [(place[int(u)], place[int(v)]) for m in masks for u, v in zip(*forest(array, m, 4), strict=True)]
        assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in links)
        changed = True
        while changed:
            changed = False
            for a, b in links:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        assert label == plain_components(fps)


def test_large_buckets_are_dealt_out(spark, rng):
    fps = family(rng, 40)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = dict(rows_of(connected_components(trie_links(df, bucket_limit=2)), "node", "root"))
    want = plain_components(fps)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(f)
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components(spark, rng):
    from llm_words import sentence

    base = sentence(rng, 300)
    changed = base.replace(base.split()[150], "other", 1)
    rows = [(5, base), (3, base), (9, changed), (1, sentence(rng, 300)), (4, None), (2, ""), (None, base), (7, " "), (7, " ")]
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], SCHEMA)
    found = simhash_components(df).collect()
    ids = [(r["doc_id"], r["component_id"]) for r in found]
    assert len(found) == len(rows)
    assert sorted(x for x in ids if x[0] in (2, 4, 7)) == [(2, 2), (4, 2), (7, 2), (7, 2)]
    assert {x for x in ids if x[0] in (3, 5, None)} == {(3, 3), (5, 3), (None, 3)} and (1, 1) in ids
    by_id = {r["doc_id"]: r["fingerprint"] for r in found}
    assert by_id[3] == f"{plain_fingerprint(base):016x}" and by_id[4] == "0" * 16
    kept = keep_one_per_component(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect() if r["doc_id"] != 9) == [-1, 1, 2, 3]


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (5, None), (200, 201)], "u long, v long")
    got = dict(rows_of(connected_components(edges), "node", "root"))
    assert got == {i: 0 for i in range(1, 61)} | {201: 200}
