"""Toxicity: held-out accuracy, gradients that learn, and the scorer's shortcuts."""

from __future__ import annotations

import numpy as np
from llm_words import sentence

from leaselake.llm.toxicity import THRESHOLD, Model, Scorer, TrainingBounds, _Corpus, _laid_out, _logits, _responses, best_cut, drop_toxic, fit_toxicity, gradients, toxicity, train, training_sample

SCHEMA = "doc_id long, text string, lang string, score double, toxic int"


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = ("en", "de", None)[i % 3]
        words = sentence(rng, rng.choice([1, 8, 60, 300])).split()
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words) + 1), f"insult{rng.choice('abcdefgh')}x")
        rows.append((i, " ".join(words), lang, int(bad)))
    return rows


def test_scorer_equals_the_model(rng):
    rows = corpus(rng, 200)
    texts = [t for _, t, _, _ in rows] + ["", None, "one", "two words"]
    labels = np.array([x for *_, x in rows] + [0] * 4, float)
    model = train(texts, labels, [None] * len(texts), np.arange(len(texts)) % 4, epochs=1)
    whole = _logits(model, _Corpus(texts, len(model.embeddings)), np.arange(len(texts)))
    scorer = Scorer(model)
    assert np.allclose([scorer.logit(t) for t in texts], whole, atol=1e-3)


def test_long_texts_are_read_whole(rng):
    rows = corpus(rng, 400)
    model = train([t for _, t, _, _ in rows], np.array([x for *_, x in rows]), [None] * 400, np.arange(400) % 3)
    scorer = Scorer(model)
    clean = sentence(rng, 70_000)
    score = lambda t: float(model.calibrated(np.array(scorer.logit(t))))
    assert score(clean) < THRESHOLD <= score(clean + " insultax")


def test_best_cut():
    assert best_cut(np.array([3.0, 1.0, 2.0, 0.0]), np.array([1, 0, 1, 0])) == 1.5
    assert best_cut(np.array([1.0]), np.array([1])) is None


def test_held_out_accuracy(spark, rng):
    rows = corpus(rng, 900)
    extra = [(1000, None, "en"), (1001, "", None), (1002, "!!", "xx"), (None, "insultax", "en"), (5, "again insultbx here", "en")]
    docs = spark.createDataFrame([(i, t, g, 0.5, 9) for i, t, g, _ in rows] + [(i, t, g, 0.5, 9) for i, t, g in extra], SCHEMA)
    labels = spark.createDataFrame([(i, 0, x) for i, *_, x in rows] + [(0, 0, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, labels).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: x for i, *_, x in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 200 and right >= 0.98 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert by_id[None]["predicted"] == 1 and not by_id[None]["held_out"] and by_id[1000]["score"] == by_id[1001]["score"] == by_id[1002]["score"]
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 1000 AND score = 0.5").count() == 1
    assert kept.count() == sum(not r["predicted"] for r in out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", "en", 0.0, 0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity(docs, labels).collect()] == [0]
    assert toxicity(docs.limit(0), labels).count() == 0


def small_model(rng, widths=(1, 2, 3), buckets=200, dim=3, per=2):
    r = np.random.default_rng(rng.randrange(99))
    model = Model(r.normal(size=(buckets, dim)), [r.normal(size=(w, dim, per)) for w in widths], r.normal(size=per * len(widths)), r.normal(size=per * len(widths)), 0.3)
    model.embeddings[0] = 0
    return model


def test_batch_is_as_good_as_single_texts(rng):
    """No filter sees the next text, for texts of no word, one, two and more."""
    texts = ["", "one", None, "two words", "three words here", "x", sentence(rng, 20), "last"]
    model = small_model(rng)
    corpus_ = _Corpus(texts, len(model.embeddings))
    feats, counts, starts, ends = _laid_out(corpus_, np.arange(len(texts)), 2)
    pooled = np.hstack([b for _, b, _ in _responses(model, model.embeddings[feats].sum(axis=1) / counts, starts, ends)]) + model.bias
    logits = np.maximum(pooled, 0) @ model.out + model.out_bias
    assert np.allclose(logits, _logits(model, corpus_, np.arange(len(texts))))
    assert np.allclose(logits, [Scorer(model).logit(t) for t in texts], atol=1e-4)


def test_gradients_by_differences(rng):
    texts = ["", "one", "two words", sentence(rng, 9), sentence(rng, 5)]
    labels, weight, rows = np.array([1.0, 0, 1, 0, 1]), np.array([0.5, 1, 2, 0.3, 1]), np.arange(5)
    model = small_model(rng)
    corpus_ = _Corpus(texts, len(model.embeddings))

    def loss():
        p = 1 / (1 + np.exp(-_logits(model, corpus_, rows)))
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    filters, out, bias, out_bias, (buckets, total) = gradients(model, corpus_, rows, labels, weight)
    dense = np.zeros_like(model.embeddings)
    dense[buckets] = total
    for values, grad in [*zip(model.filters, filters), (model.out, out), (model.bias, bias), (model.embeddings, dense)]:
        places = [p for p in np.ndindex(values.shape) if values is not model.embeddings or p[0] in set(buckets[buckets > 0].tolist())]
        for place in rng.sample(places, min(25, len(places))):
            before = values[place]
            values[place] = before + 1e-6
            up = loss()
            values[place] = before - 1e-6
            down = loss()
            values[place] = before
            assert abs((up - down) / 2e-6 - grad[place]) < 1e-4, place
    model.out_bias += 1e-6
    up = loss()
    model.out_bias -= 2e-6
    assert abs((up - loss()) / 2e-6 - out_bias) < 1e-4


def test_thresholds_by_language(spark, rng):
    """A language whose scores lie lower gets a threshold of its own."""
    rows = corpus(rng, 900)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, *_, x in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert set(model.thresholds) == {"", "de", "en"} and all(0 < x < 1 for x in model.thresholds.values())
    model.thresholds |= {"de": 0.0, "en": 1.1}
    from pyspark.sql import functions as F

    from leaselake.llm.toxicity import language_threshold

    found = {r["lang"]: r["t"] for r in docs.select("lang", language_threshold(F.col("lang"), model).alias("t")).distinct().collect()}
    assert found["de"] == 0.0 and found["en"] == 1.1 and found[None] == model.thresholds[""]


def test_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "w" * 10 * (i + 1), None) for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = training_sample(docs, labels, bounds=TrainingBounds(10, 10, 2000)).toPandas()
    for label in (0, 1):
        mine = rows[rows.label == label]
        assert 0 < len(mine) <= 10 and mine.text.str.len().sum() <= 2000
    assert training_sample(docs, labels).count() == training_sample(docs, labels, bounds=TrainingBounds(100, 100, 10**6)).count()


def test_giant_texts_cost_no_label(spark):
    """A text beyond the bound is passed over, wherever it stands; a label of such
    texts alone gives the beginning of the shortest."""
    long = {i: "l" * (5000 + i) for i in range(0, 60, 4)}
    docs = spark.createDataFrame([(i, long.get(i, f"w{i} " * 20), None) for i in range(60)], "doc_id long, text string, lang string")
    for giant in (1, 0):
        labels = spark.createDataFrame([(i, giant if i in long else 1 - giant if i % 2 else giant) for i in range(60)], "doc_id long, toxic int")
        rows = training_sample(docs, labels, bounds=TrainingBounds(100, 100, 4000)).toPandas()
        assert set(rows.label) == {0, 1} and not any(t.startswith("l") for t in rows.text)
        only = labels.where(f"toxic <> {giant} OR doc_id % 4 = 0")
        rows = training_sample(docs, only, bounds=TrainingBounds(100, 100, 4000)).toPandas()
        assert rows[rows.label == giant].text.tolist() == ["l" * 4000]


def test_all_labelled_rows_are_learned_from(spark, rng, monkeypatch):
    """With more rows than one task is given, no row is left out of the fit, and the
    mean of four tasks' networks still tells apart."""
    from leaselake.llm import toxicity as module

    rows = [(i, t, g, int(i % 5 == 0)) for i, t, g, _ in corpus(rng, 1500)]
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, *_, x in rows], "doc_id long, toxic int")
    seen = []
    calibrate = module._calibrate
    monkeypatch.setattr(module, "_calibrate", lambda model, z, y, langs, n: seen.append((n.sum(), (y * n).sum())) or calibrate(model, z, y, langs, n))
    monkeypatch.setattr(module.TrainingBounds, "__init__", None)  # no sample is taken
    model = fit_toxicity(docs, labels, rows_per_shard=250)
    training = labels.where(module.in_training(labels["doc_id"]))
    assert seen == [(training.count(), training.where("toxic = 1").count())]
    scorer = Scorer(model)
    score = lambda t: float(model.calibrated(np.array(scorer.logit(t))))
    assert score(sentence(rng, 60)) < THRESHOLD <= score(sentence(rng, 60) + " insultax")


def test_pieces_of_long_texts(rng, monkeypatch):
    """Gradients of a text cut into pieces are those of the whole."""
    from leaselake.llm import toxicity as module

    texts = [sentence(rng, n) for n in (1, 2, 30, 31, 32, 33, 90)]
    model, rows = small_model(rng), np.arange(7)
    corpus_ = _Corpus(texts, len(model.embeddings))
    given = (corpus_, rows, np.array([1.0, 0, 1, 0, 1, 0, 1]), np.ones(7))
    whole = gradients(model, *given)
    monkeypatch.setattr(module, "WORDS_AT_ONCE", 10)
    parts = gradients(model, *given)
    for a, b in zip([*whole[0], *whole[1:4], *whole[4]], [*parts[0], *parts[1:4], *parts[4]], strict=True):
        assert np.allclose(a, b)


def test_buckets_of_words():
    """Made for many words at once, they are those of the words' checksums one by one."""
    import zlib

    from leaselake.llm.toxicity import features

    words = ["", "a", "abc", "abcd", "abcde", "abcdef", "abcdefg", "éàüöß", "ééééééééé", "\ud800bcdefg", "日本語テキストです", "a日b語cテdキ"]
    for word, row in zip(words, features(words, 1000).tolist(), strict=True):
        parts = [word, *("^" + word[:n] for n in (3, 4, 5, 6) if len(word) > n or n == 3)]
        assert row == ([1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % 999 for p in parts] + [0] * 4)[:5]


def test_scorer_forgets_words(rng, monkeypatch):
    """What a task keeps is bounded, and forgetting changes no score."""
    from leaselake.llm import toxicity as module

    model = small_model(rng)
    texts = ["", *(f"w{i} " * (i % 5) + sentence(rng, i % 50) + f" x{i} y{i}" for i in range(300)), None, "one"]
    whole = Scorer(model).logits(texts)
    monkeypatch.setattr(module, "WORDS_KEPT", 50)
    monkeypatch.setattr(module, "WORDS_AT_ONCE", 16)
    monkeypatch.setattr(module, "WORDS_TOGETHER", 30)
    scorer = Scorer(model)
    assert np.allclose(scorer.logits(texts), whole, atol=1e-6) and np.allclose([scorer.logit(t) for t in texts], whole, atol=1e-6)
    assert len(scorer.known) <= len(scorer.rows) <= 90
    coded = [*module.Encoder(200).encoded(texts)]
    again = _Corpus.of(*map(list, zip(*coded, strict=True)))
    plain = _Corpus(texts, 200)
    assert all((again.feats[a] == plain.feats[b]).all() for a, b in zip(again.docs, plain.docs, strict=True))
    monkeypatch.undo()
    assert Scorer(side := module.side_by_side([module._drawn(np.random.default_rng(0), 1 << 15, 12, 4, (1, 2, 3))] * 4)).rows.nbytes < 40e6 and side.filters[0].shape == (1, 48, 16)


def test_labels_find_their_texts_by_one_plan(spark, monkeypatch):
    """Small labels are not broadcast, so that what is shuffled grows as the input; texts without a
    label mostly stay behind, and none with one does, however many ids share a bit."""
    from leaselake.llm import toxicity as module

    docs = spark.createDataFrame([(i, f"t{i}", None) for i in [*range(3000), -7, None]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(0, 3000, 30), -7, 9999]] + [(None, 1)], "doc_id long, toxic int")
    texts = module._texts(docs, "doc_id", "text", "lang")
    for marks in (module.MARKS, 64, 1):
        monkeypatch.setattr(module, "MARKS", marks)
        for kind in ("long", "int", "string"):
            kinds = module._kinds(labels.withColumn("doc_id", labels["doc_id"].cast(kind)), "doc_id", "toxic")
            joined = module._labelled(texts, kinds)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and ("getbit" in plan) == (kind == "long")
            assert sorted(map(tuple, joined.select("_id", "text", "label").collect())) == sorted(map(tuple, texts.join(kinds, "_id").select("_id", "text", "label").collect()))
