"""Kneser-Ney models: probabilities by hand, sums to one, held-out accuracy."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from leaselake.llm import language_id as L

SYLLABLES = {"aa": "tion the ing ed er on".split(), "bb": "sch ung ver ein lich".split(), "cc": "ión que los ar ñ".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def plain_probability(counts, order, gram, alphabet):
    """Interpolated Kneser-Ney of the last character, from counters by order."""
    if not gram:
        return 1 / alphabet
    table = counts[len(gram)]
    ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
    discount = ones / (ones + 2 * twos) if ones else 0.5
    same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
    total = sum(same.values())
    lower = plain_probability(counts, order, gram[1:], alphabet)
    if not total:
        return lower
    return max(table.get(gram, 0) - discount, 0) / total + discount * len(same) / total * lower


def test_probabilities():
    rng = random.Random(3)
    sample = {g: [text(rng, g, 12), text(rng, g, 3)] for g in ("aa", "bb")}
    models = L.fit(sample, order=3)
    alphabet = len({c for t in sample.values() for x in t for c in f" {x} "}) + 1
    clean = lambda t: "".join(map(chr, L.letters_of(t)))
    for j, lang in enumerate(models.languages):
        padded = ["  " + clean(t) for t in sample[lang]]
        counts = {3: Counter(p[i - 2 : i + 1] for p in padded for i in range(2, len(p)))}
        for k in (2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        for probe in (sample["aa"][1], sample["bb"][1], "thung ver xyz éé", "q"):
            p = "  " + clean(probe)
            want = -np.mean([np.log(plain_probability(counts, 3, p[i - 2 : i + 1], alphabet)) for i in range(2, len(p))])
            assert L.cross_entropy(models, probe)[j] == pytest.approx(want, rel=1e-4)


def test_pieces_join(monkeypatch):
    rng = random.Random(4)
    models = L.fit({g: [text(rng, g, 50)] for g in SYLLABLES})
    probe = text(rng, "aa", 40) + " zz " + text(rng, "cc", 40)
    whole = L.cross_entropy(models, probe)
    for size in (5, 17, 64):
        monkeypatch.setattr(L, "CHARS_AT_ONCE", size)
        assert L.cross_entropy(models, probe) == pytest.approx(whole, rel=1e-4)


def test_letters():
    assert [L.has_letter(t) for t in (None, "", "12 _ ?!", "²", "a", "1é", "ß")] == [False, False, False, False, True, True, True]


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang, rng.choice([2, 20, 100])), lang, 0.0, "x") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (903, text(rng, "cc", 30), None), (None, text(rng, "bb", 30), "aa"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows + [(i, t, g, 0.0, "x") for i, t, g in odd], "doc_id long, text string, lang string, score double, lang_pred string")
    out = L.language_id(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in out}
    held = [r for r in rows if by_id[r[0]]["held_out"]]
    assert len(held) > 150 and sum(by_id[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903]["lang_pred"] == "cc" and by_id[None]["lang_pred"] == "bb" and not by_id[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out)
    added = L.identify_languages(docs, L.fit_languages(docs))
    assert sorted(added.columns) == sorted(["doc_id", "text", "lang", "score", "lang_pred", "rejected"])
    assert not added.where("doc_id = 903").first()["rejected"]


def test_rejection():
    rng = random.Random(6)
    models = L.fit({g: [text(rng, g, 400)] for g in SYLLABLES})
    L.calibrate(models, [text(rng, g, 60) for g in SYLLABLES for _ in range(25)], [g for g in SYLLABLES for _ in range(25)])
    assert not L.predict(models, text(rng, "aa", 60))[2]
    assert L.predict(models, "zzqxj kkwvv " * 30)[2]


def test_giant_texts_cost_no_language(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, "aa", 40), "aa") for i in range(50)] + [(i, text(rng, "bb", 40), "bb") for i in range(100, 150)]
    rows += [(i, "x" * 3000 + text(rng, "bb", 300), "bb") for i in range(200, 260)] + [(300, text(rng, "cc", 2000), "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.training_sample(docs, "doc_id", "text", "lang", L.TrainingBounds(400, 3000))
    chars = sample.groupby("lang")["text"].agg(lambda x: x.str.len().sum())
    assert set(sample.lang) == {"aa", "bb", "cc"} and (chars <= 3000).all() and chars["cc"] == 3000
    assert L.fit_languages(docs, bounds=L.TrainingBounds(400, 3000)).languages == ["aa", "bb", "cc"]


def test_empty(spark):
    schema = "doc_id long, text string, lang string"
    assert L.language_id(spark.createDataFrame([], schema)).count() == 0
    assert [r["lang_pred"] for r in L.language_id(spark.createDataFrame([(2, "abc", None)], schema)).collect()] == ["und"]
