"""Log tables: merge on read against a dictionary, cost of batches, reruns, days."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from shared_rows import rows_of

from leaselake.streaming.tables import LogTable, day_table, dimension_table, drop_old_days


def written(path) -> dict[str, int]:
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_merge_on_read(spark, tmp_path):
    """Upserts and deletes over many batches, with and without compaction."""
    rng, held = random.Random(3), {}
    table = dimension_table(spark, str(tmp_path / "t"), ["id", "name"])
    assert not table.exists() and table.read().count() == 0
    for batch in range(14):
        keys = rng.sample([f"k{n}" for n in range(12)] + [None], rng.randrange(1, 9))
        rows = [(k, rng.random() < 0.3, k, f"{batch}") for k in keys]
        table.append(spark.createDataFrame(rows, "key string, deleted boolean, id string, name string"), batch)
        for k, gone, *rest in rows:
            held.pop(k, None) if gone else held.__setitem__(k, (k, rest[0] or "", rest[1]))
        if batch in (4, 9, 13):
            table.compact(batches=3) if batch != 9 else table.compact()
        if batch % 3 == 1 or batch > 11:
            assert rows_of(table.read()) == sorted(held.values(), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert table.compact() == [] and table.batches() == [] and len(table.bases()) > 1  # what was folded goes with the next compaction


def test_small_batches_write_little(spark, tmp_path):
    """Ten changes of a million rows write far under a hundredth of the table."""
    table = dimension_table(spark, str(tmp_path / "t"), ["id", "name"])
    rows = spark.range(1_000_000).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    table.append(rows, 0)
    table.compact()
    before = written(tmp_path / "t")
    table.append(rows.where("key < 10 AND length(key) = 1").withColumn("name", F.lit("new")), 1)
    assert table.compact() == []
    new = sum(size for path, size in written(tmp_path / "t").items() if path not in before)
    assert 0 < new < 0.01 * sum(before.values())
    assert table.read().count() == 1_000_000 and table.read().where("name = 'new'").count() == 10


def test_hundred_batches_into_a_day(spark, tmp_path):
    """What is written grows with the rows, not with batches times the day."""
    table = day_table(spark, str(tmp_path / "t"), "cur_date string, k long, n long", ["cur_date", "k"])
    rows, paths = 0, {}
    for batch in range(100):
        part = spark.range(batch * 20, batch * 20 + 40).select(F.lit("2024-01-01").alias("cur_date"), F.col("id").alias("k"), F.lit(batch).cast("long").alias("n")).coalesce(1)
        table.append(part, batch)
        rows += 40
        paths |= dict.fromkeys(written(tmp_path / "t"))
        if batch % 20 == 19:
            table.compact()
            paths |= {p: None for p in written(tmp_path / "t")}
    assert len(paths) <= 110  # a file a batch, and a few compactions
    assert rows_of(table.read().agg(F.count("*"), F.sum("n"))) == [(2020, sum(20 * n for n in range(99)) + 40 * 99)]


def test_batches_run_once(spark, tmp_path):
    table = dimension_table(spark, str(tmp_path / "t"), ["v"])
    df = lambda v: spark.createDataFrame([("a", v)], "key string, v string")
    assert table.append(df("1"), 0) and not table.append(df("x"), 0)
    assert table.append(df("2"), 1)
    table.compact(batches=0)
    assert not table.append(df("x"), 0) and not table.append(df("x"), 1)  # folded, and known all the same
    assert rows_of(table.read()) == [("a", "2")]
    assert table.append(df("3"), 2) and rows_of(table.read()) == [("a", "3")]


def test_broken_runs_leave_the_table_whole(spark, tmp_path):
    table = dimension_table(spark, str(tmp_path / "t"), ["v"])
    table.append(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, v string"), 0)
    (tmp_path / "t/base/_part=003/_v=9").mkdir(parents=True)  # a base that never got its mark
    (tmp_path / "t/_compact").mkdir()
    (tmp_path / "t/_0_7").mkdir()  # a batch that never got its place
    assert rows_of(table.read()) == [("a", "1"), ("b", "1")]
    table.append(spark.createDataFrame([("a", True, None)], "key string, deleted boolean, v string"), 1)
    table.compact(batches=0)
    assert rows_of(table.read()) == [("b", "1")]
    table.drop()
    assert not table.exists()
    with pytest.raises(ValueError):
        LogTable(spark, "x", "_part string", ["_part"], F.col("_part"))


def test_days_go(spark, tmp_path):
    table = day_table(spark, str(tmp_path / "t"), "cur_date string, n long", ["cur_date"])
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-20')) AS d").select(F.col("d").cast("string").alias("cur_date"), F.lit(1).cast("long").alias("n"))
    table.append(days.where("cur_date < '2024-01-11'"), 0)
    table.compact()
    table.append(days, 1)
    gone = drop_old_days(table, "2024-01-10", keep=3, ahead=4)
    assert gone[0] == "2024-01-01" and gone[-1] == "2024-01-20" and len(gone) == 12
    assert [r["cur_date"] for r in table.read().orderBy("cur_date").collect()] == [f"2024-01-{n:02d}" for n in range(7, 15)]
    assert table.read_parts(["2024-01-08"]).count() == 1
    table.compact(batches=0)
    assert table.read().count() == 8


def days(session):
    """100 rows of each of ten days in each of four partitions."""
    day = F.concat(F.lit("2024-01-1"), F.col("id") % 10)
    return session.range(0, 4000, 1, 4).select(day.alias("cur_date"), F.col("id").alias("k"))


def test_a_stream_writes_a_file_a_part(spark, tmp_path):
    """A stream's session plans without adaptive execution, and keeps that."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    table = day_table(session, str(tmp_path / "t"), "cur_date string, k long", ["cur_date", "k"])
    table.append(days(session), 0)
    assert len(written(tmp_path / "t")) == 10
    assert session.conf.get("spark.sql.adaptive.enabled") == "false"
    assert table.read().count() == 4000


def test_parts_of_one_batch_wait(spark, tmp_path):
    table = day_table(spark, str(tmp_path / "t"), "cur_date string, k long", ["cur_date", "k"])
    table.append(days(spark), 0)
    assert table.compact(least=2) == []
    table.append(days(spark).where("cur_date = '2024-01-13'"), 1)
    assert table.compact(least=2) == ["2024-01-13"]
    assert table.read().count() == 4000
    assert len(table.compact()) == 9
