"""Bounded runs of the joined jobs: batches pair with the layer, and keep what waits only."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from shared_rows import SF, rows_of
from test_lifecycle import ADD, APPLY, CREDIT, OCCUPY, REPLY, STATUS
from test_streams import write

from leaselake.plans import queries
from leaselake.scratch import NO_LEFTOVERS
from leaselake.streaming import jobs
from leaselake.streaming.sinks import fan_out, read_layer


def at(change, **data):
    return (*change[:2], change[2] | data)


T = [f"2024-01-01 00:00:{n:02d}.000000" for n in range(10)]
APPLIED, REPLIED = at(APPLY, update_time=T[1]), at(REPLY, create_time=T[2])
ADDED, OCCUPIED = at(ADD, create_time=T[3]), at(OCCUPY, credit_occupy_time=T[4])


def facts(spark, layer):
    return {k: rows_of(jobs.facts_of(spark, layer, k), "id") for k in ("audit_approve", *jobs.CREDIT_FACTS)}


def run(spark, tmp_path, parts):
    """The facts after each part of a log."""
    log, layer, found = tmp_path / "log", str(tmp_path / "layer"), []
    for n, part in enumerate(parts):
        write(log, f"{n}.txt", part, 10 * n)
        jobs.joined_fact_jobs(spark, str(log), layer, str(tmp_path / "checkpoint"), available_now=True)
        found.append(facts(spark, layer))
    return found


def test_sides_wait_for_each_other(spark, tmp_path):
    other = [at(APPLIED, id="2"), at(REPLIED, credit_facility_id="2", id="8"), at(ADDED, credit_facility_id="2", id="6")]
    parts = [[ADDED, STATUS, other[0]], [REPLIED, OCCUPIED, other[2]], [("reply", "insert", {"credit_facility_id": "7"}), other[1]], [APPLIED]]
    found = run(spark, tmp_path, parts)
    none = {"audit_approve": [], "credit_add": [], "credit_occupy": [], "contract_produced": []}
    assert found[:2] == [none, none]
    assert found[2] == none | {"audit_approve": [("2",)], "credit_add": [("6",)]}
    assert found[3] == none | {"audit_approve": [("1",), ("2",)], "credit_add": [("5",), ("6",)], "credit_occupy": [("5",)]}
    layer = str(tmp_path / "layer")
    assert rows_of(jobs.facts_of(spark, layer, "audit_approve"), "id", "audit_man_id", "reply_id", "reply_time") == [("1", "9", REPLIED[2]["id"], T[2]), ("2", None, "8", T[2])]
    assert rows_of(jobs.facts_of(spark, layer, "credit_occupy"), "id", "credit_facility_id", "occupy_time") == [("5", "1", T[4])]


def test_what_comes_again_counts_once(spark, tmp_path):
    """In the same batch and in later ones; a further end of an application takes the reply
    that is used already, but credits have one approval."""
    later = at(APPLIED, update_time=T[9])
    parts = [[APPLIED, REPLIED, ADDED, ADDED, at(REPLIED, id="99")], [APPLIED, REPLIED, ADDED, OCCUPIED], [later, OCCUPIED, at(ADDED, create_time=T[8])]]
    first, second, third = run(spark, tmp_path, parts)
    assert first == {"audit_approve": [("1",)], "credit_add": [("5",)], "credit_occupy": [], "contract_produced": []}
    assert second == first | {"credit_occupy": [("5",)]}
    assert third == second | {"audit_approve": [("1",), ("1",)], "credit_add": [("5",), ("5",)]}
    assert rows_of(jobs.facts_of(spark, str(tmp_path / "layer"), "audit_approve"), "approve_time", "reply_id") == [(T[1], REPLIED[2]["id"]), (T[9], REPLIED[2]["id"])]


def test_produced_contracts_keep_their_credit(spark, tmp_path):
    produced = ("credit", "update", CREDIT | {"status": "3", "contract_produce_time": T[6], "contract_id": "77"})
    first, second, third = run(spark, tmp_path, [[produced], [APPLIED, REPLIED], [produced]])
    assert first["contract_produced"] == [] and second["contract_produced"] == third["contract_produced"] == [("77",)]
    assert rows_of(jobs.facts_of(spark, str(tmp_path / "layer"), "contract_produced"), "credit_id", "produced_time") == [("5", T[6])]


def test_nothing_that_is_paired_is_kept(spark, tmp_path):
    """No state of all approvals, replies and credits: what waits, and no more."""
    run(spark, tmp_path, [[APPLIED, REPLIED, ADDED], [OCCUPIED, at(ADDED, credit_facility_id="3"), ("reply", "insert", {"credit_facility_id": "7"})], [at(STATUS, credit_facility_id="8")]])
    checkpoint = tmp_path / "checkpoint"
    assert not [p for p in checkpoint.rglob("state") if any(p.iterdir())]
    last = {k: spark.read.schema(jobs.PAYLOAD).parquet(str(max((checkpoint / "unmet" / k).iterdir(), key=lambda p: int(p.name.split("_")[-1])))).count() for k in ("early_reply", "early_approval", "early_credit")}
    assert last == {"early_reply": 1, "early_approval": 0, "early_credit": 1}
    assert all(len(list((checkpoint / "unmet" / k).iterdir())) <= 2 for k in last)


def test_a_batch_is_completed_from_one_run(spark, tmp_path):
    """One that died after its write and between two kinds isn't worked out again, when the
    layers may hold more."""
    layer = str(tmp_path / "layer")
    batch = spark.createDataFrame([("a", "1"), ("b", "2")], "kind string, payload string")
    batch.withColumn("_kind", F.col("kind")).write.partitionBy("_kind").parquet(f"{layer}/_0")
    (tmp_path / "layer/a").mkdir()
    (tmp_path / "layer/_0/_kind=a").rename(tmp_path / "layer/a/batch=0")
    fan_out(("a", "b", "none"), layer)(batch.where("false"), 0)
    assert {k: rows_of(read_layer(spark, f"{layer}/{k}", jobs.PAYLOAD)) for k in ("a", "b", "none")} == {"a": [("a", "1")], "b": [("b", "2")], "none": []}


def test_a_job_leaves_its_facts_only(spark, monkeypatch):
    """The topic and the checkpoint of a job that has read all of it go; so do shuffled rows."""
    logs, checkpoints = [], []
    write_topic, job = queries._log_files, jobs.joined_fact_jobs
    monkeypatch.setattr(queries, "_LAYERS", {})
    monkeypatch.setattr(queries, "_log_files", lambda *a: logs.append(write_topic(*a)) or logs[-1])
    monkeypatch.setattr(jobs, "joined_fact_jobs", lambda spark, log, layer, checkpoint, **k: checkpoints.append(checkpoint) or job(spark, log, layer, checkpoint, **k))
    layer = queries._fact_layer(spark, SF, "credit_add")
    assert len(logs) == len(checkpoints) == 3 and jobs.facts_of(spark, layer, "credit_add").count() > 0
    assert not [p for p in logs + checkpoints if Path(p.removeprefix("file://")).exists()]
    session = jobs.job_session(spark)
    assert all(session.conf.get(k) == v for k, v in NO_LEFTOVERS.items())


@pytest.mark.parametrize("joined", [True, False])
def test_all_cores_read_a_batch(spark, monkeypatch, joined):
    """A compressed file is one task's: a batch has as many files as there are cores, or
    more, and its messages aren't shuffled before they are parsed."""
    seen = []
    name = "joined_fact_jobs" if joined else "fact_job"
    job = getattr(jobs, name)
    monkeypatch.setattr(jobs, name, lambda spark, log, *a, files_per_batch, **k: seen.append((log, files_per_batch, len(list(Path(log.removeprefix("file://")).glob("part-*"))))) or job(spark, log, *a, files_per_batch=files_per_batch, **k))
    queries.stream_facts_out_of_order(joined, spark, SF)
    cores = spark.sparkContext.defaultParallelism
    assert seen and all(cores <= each and 2 * each < files <= 3 * each for _, each, files in seen)
    values = spark.range(8).select(F.col("id").cast("string").alias("value"))
    assert jobs._spread(values, cores) is values is jobs._spread(values, None)
    assert jobs._spread(values, 1).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
