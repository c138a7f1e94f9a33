"""The pipeline's stages on the smallest tables, each held against its operator."""

from __future__ import annotations

import pytest
from shared_rows import SF

import corpus_pipeline
from leaselake.llm.decontamination import decontaminate
from leaselake.llm.mixing import mix_sources
from leaselake.llm.packing import END_OF_TEXT
from leaselake.llm.queries import QUERIES, SQL
from leaselake.llm.simhash_pairs import similar_components
from leaselake.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Documents that each stage reads, as the pipeline writes them."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path_factory.mktemp(name) / "out")
        step(spark, docs[-1], SF).write.parquet(path)
        docs.append(spark.read.parquet(path))
        assert docs[-1].columns == docs[0].columns
    return docs


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "packing"]
    assert sum(n.startswith("op") for n in QUERIES) == 13 and SQL.keys() < QUERIES.keys()


def test_toxicity(spark, kept):
    scored = toxicity(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept[1]) == ids(scored.where("predicted = 0"))


def test_near_duplicates(spark, kept):
    assert ids(kept[2]) == ids(similar_components(kept[1]).where("doc_id = component_id"))


def test_decontamination(spark, kept):
    assert ids(kept[3]) == ids(decontaminate(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated"))


def test_mixing(spark, kept):
    wanted = [r["doc_id"] for r in mix_sources(kept[3]).collect() for _ in range(r["copies"])]
    assert ids(kept[4]) == sorted(wanted)


def test_packing(spark, kept):
    rows = corpus_pipeline.pack(spark, kept[4], SF).collect()
    found = sorted(d for r in rows for d, at in zip(r["doc_ids"], r["part_offsets"]) if at == 0)
    assert found == ids(kept[4]) and END_OF_TEXT == 50256


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def tables(spark, path, docs):
    """Documents with columns whose names clash with those the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, score double, node string, row int"
    spark.createDataFrame([(*d, 1, 0.5, "n", 2) for d in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(20)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "one two three four five six seven eight nine ten"), (None, "red orange yellow green blue indigo violet"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_odd_rows_pass_every_stage(spark, tmp_path, rng):
    """Null ids, texts and sources, repeated rows and ids, a very long text."""
    from llm_words import sentence

    long = sentence(rng, 40_000)
    docs = [(i, sentence(rng, 40) + (" insultax" if i % 5 == 0 else ""), "en", "ab"[i % 2], 9) for i in range(20)]
    docs += [(None, None, None, None, None), (None, sentence(rng, 30), None, None, None), (30, "", None, "a", 0), (31, long, "en", "a", 1), (32, long + " more", "en", "b", 1)]
    docs += [docs[1], (1, "same id, other text", "de", None, 3), (33, "so red orange yellow green blue indigo violet it is", "en", "a", 3)]
    path = tables(spark, str(tmp_path), docs)
    kept = [spark.read.parquet(f"{path}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept[-1], path)
        assert out.columns == kept[0].columns
        out.write.parquet(f"{path}/{name}")
        # twenty labels don't tell clean from toxic, so the next stage reads all documents
        kept.append(kept[0] if name == "toxicity" else spark.read.parquet(f"{path}/{name}"))
    after = [sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in k.collect()) for k in kept]
    assert 31 in after[1] and 31 in after[2] and 32 not in after[2]
    assert after[2].count(-1) == after[1].count(-1) > 0  # nothing names rows without an id
    assert 33 in after[2] and 33 not in after[3]
    assert set(after[4]) <= set(after[3])
    assert corpus_pipeline.run(spark, path).count() > 0


def test_empty_tables(spark, tmp_path):
    path = tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, path).count() == 0
