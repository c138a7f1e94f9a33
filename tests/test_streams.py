"""Streams: several micro-batches, a restart, watermark and fan-out."""

from __future__ import annotations

import json
import time

from shared_rows import rows_of
from pyspark.sql import functions as F
from test_lifecycle import ADD, APPLY, CREDIT, OCCUPY, REPLY, STATUS

from leaselake import schemas as S
from leaselake.operators.windows import tumbling_summary
from leaselake.streaming import jobs
from leaselake.streaming.lifecycle import APPLICATION_CELLS, ApplicationLifecycle, expiry
from leaselake.functions import event_time
from leaselake.plans.change_log import as_json, write_log
from leaselake.sources.changelog import read_values
from leaselake.streaming.sinks import append_batch, console, exists, fan_out, read_layer, text_files
from leaselake.streaming.tables import dimension_table


def write(path, name, changes, start):
    lines = [json.dumps({"database": "l", "table": t, "type": k, "ts": start + n, "xid": 0, "xoffset": n, "data": d, "old": None}) for n, (t, k, d) in enumerate(changes)]
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))


def test_fact_job_restarts(spark, tmp_path):
    log, layer = tmp_path / "log", str(tmp_path / "layer")
    for n, part in enumerate([[STATUS, ADD], [APPLY], [REPLY, OCCUPY]]):
        write(log, f"{n}.txt", part, 10 * n)
        query = jobs.fact_job(spark, str(log), layer, str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination()
    assert rows_of(jobs.facts_of(spark, layer, "audit_approve"), "id", "audit_man_id") == [("1", "9")]
    assert rows_of(jobs.facts_of(spark, layer, "credit_add"), "id") == [("5",)]
    assert rows_of(jobs.facts_of(spark, layer, "credit_occupy"), "id") == [("5",)]
    assert jobs.facts_of(spark, layer, "audit_reject").count() == 0


def test_stash_expires(spark, tmp_path):
    log, layer = tmp_path / "log", str(tmp_path / "layer")
    write(log, "0.txt", [APPLY, ADD], 0)
    query = jobs.fact_job(spark, str(log), layer, str(tmp_path / "checkpoint"), mode="strict", early_ttl_ms=1)
    try:
        end = time.time() + 90
        while time.time() < end and not query.lastProgress:
            time.sleep(0.5)
        time.sleep(1)
        write(log, "1.txt", [REPLY], 10)
        while time.time() < end:
            try:
                if jobs.facts_of(spark, layer, "audit_approve").count():
                    break
            except Exception:  # the layer's first batch is not written yet
                pass
            time.sleep(1)
        assert jobs.facts_of(spark, layer, "audit_approve").count() == 1
        assert jobs.facts_of(spark, layer, "credit_add").count() == 0
    finally:
        query.stop()
    early = {name for name, (_, _, early) in ApplicationLifecycle.cells.items() if early}
    assert early == {"add", "occupy", "produced"} == {name for name, ms in expiry(ApplicationLifecycle.cells, 5, 9).items() if ms == 5}


def wait_for(query, batches, seconds=120):
    """Until a job has run so many batches with rows."""
    end = time.time() + seconds
    while time.time() < end and sum(p["numInputRows"] > 0 for p in query.recentProgress) < batches:
        time.sleep(0.2)


def test_early_rows_expire_each_by_themselves(spark, tmp_path):
    """Batches start every 10 s: an added row at 0 s, an occupied one at 10 s, the reply
    at 20 s. Rows wait for 15 s, so the first is gone and the second is not: a row
    that comes later does not keep those before it alive, in its own list or another."""
    log, layer = tmp_path / "log", str(tmp_path / "layer")
    again = ("credit", "insert", CREDIT | {"id": "55", "status": "1"})
    write(log, "0.txt", [APPLY, ADD], 0)
    query = jobs.fact_job(spark, str(log), layer, str(tmp_path / "checkpoint"), early_ttl_ms=15_000)
    try:
        wait_for(query, 1)
        write(log, "1.txt", [OCCUPY, again], 10)
        wait_for(query, 2)
        write(log, "2.txt", [REPLY], 20)
        wait_for(query, 3)
    finally:
        query.stop()
    found = {k: rows_of(jobs.facts_of(spark, layer, k), "id") for k in ("audit_approve", "credit_add", "credit_occupy")}
    assert found == {"audit_approve": [("1",)], "credit_add": [("55",)], "credit_occupy": [("5",)]}


def test_joined_jobs_that_run_on(spark, tmp_path):
    """The chained joins with their watermarks: every order, a second reply and a step
    that comes twice."""
    at = lambda change, **times: (*change[:2], change[2] | times)
    time_of = {"create_time": "2024-01-01 00:00:03.000000", "credit_occupy_time": "2024-01-01 00:00:09.000000"}
    apply, reply = at(APPLY, update_time="2024-01-01 00:00:01.000000"), at(REPLY, create_time="2024-01-01 00:00:02.000000")
    log, layer = tmp_path / "log", str(tmp_path / "layer")
    write(log, "0.txt", [at(ADD, **time_of), STATUS, reply], 0)
    queries = jobs.joined_fact_jobs(spark, str(log), layer, str(tmp_path / "checkpoint"))
    try:
        wait_for(queries[0], 1)
        write(log, "1.txt", [apply, at(ADD, **time_of), at(reply, id="8"), ("reply", "insert", {"credit_facility_id": "2"})], 10)
        wait_for(queries[2], 2)
        write(log, "2.txt", [at(OCCUPY, **time_of), STATUS], 20)
        end = time.time() + 90
        while time.time() < end and not (exists(spark, f"{layer}/credit_occupy") and jobs.facts_of(spark, layer, "credit_occupy").count()):
            time.sleep(1)
    finally:
        for query in queries:
            query.stop()
    found = {k: rows_of(jobs.facts_of(spark, layer, k), "id") for k in jobs.APPLICATION_FACTS}
    assert found == {"audit_approve": [("1",)], "audit_cancel": [], "audit_reject": [], "credit_add": [("5",)], "credit_occupy": [("5",)], "contract_produced": []}
    assert rows_of(jobs.facts_of(spark, layer, "audit_approve"), "audit_man_id") == [("9",)]


def test_logs_are_compressed(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("credit").alias("table"), F.create_map(F.lit("credit_facility_id"), F.col("id").cast("string")).alias("data"))
    write_log(as_json(rows), str(tmp_path / "log"))
    plain = as_json(rows).agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(p.stat().st_size for p in (tmp_path / "log").iterdir()) < plain / 5
    assert read_values(spark, str(tmp_path / "log")).count() == 20_000


def test_fan_out_once(spark, tmp_path):
    """Each kind once, also those without rows; a second run of a batch changes nothing,
    and one that died between two kinds is completed."""
    batch = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3"), ("c", "4")], "kind string, payload string")
    layer = str(tmp_path / "layer")
    append_batch(batch.where("kind = 'b'"), f"{layer}/b", 0)
    for _ in range(2):
        fan_out(("a", "b", "none"), layer)(batch, 0)
    found = {k: rows_of(read_layer(spark, f"{layer}/{k}", jobs.PAYLOAD)) for k in ("a", "b", "none")}
    assert found == {"a": [("a", "1"), ("a", "3")], "b": [("b", "2")], "none": []}
    assert sorted(p.name for p in (tmp_path / "layer").iterdir() if not p.name.startswith(".")) == ["a", "b", "none"] and not spark.sparkContext._jsc.getPersistentRDDs()


def test_quarantine(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ["{cut", "[1]", "7", '{"table": null, "type": "insert"}', '{"table": "t"}', "", '{"table": "t", "type": "insert"}', "\x00"]
    for run in range(2):
        (tmp_path / f"log/{run}.txt").write_text("\n".join(lines))
        jobs.quarantine_job(spark, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "c"), available_now=True).awaitTermination()
        found = rows_of(spark.read.parquet(str(tmp_path / "bad")).groupBy("reason").count())
        assert found == [("no JSON", 2 + 2 * run), ("no table", 3 + 3 * run), ("no type", 1 + run)]


def test_dimension_job(spark, tmp_path):
    log = tmp_path / "log"
    config = spark.createDataFrame([("e", "dim_e", "f", "id,name", "id")], S.TABLE_PROCESS)
    for n, part in enumerate([[("e", "insert", {"id": "1", "name": "a"})], [("e", "update", {"id": "1", "name": "b"}), ("e", "insert", {"id": "2"})]]):
        write(log, f"{n}.txt", part, 10 * n)
        jobs.dimension_job(spark, str(log), lambda: config, str(tmp_path / "dims"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert rows_of(dimension_table(spark, str(tmp_path / "dims/dim_e"), ["id", "name"]).read()) == [("1", "1", "b"), ("2", "2", "")]


def test_late_rows_are_dropped(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    for part in [["00:00:03", "00:00:25"], ["00:00:04", "00:00:26"], ["00:01:00"]]:
        rows = spark.createDataFrame([(f"2024-01-01 {t}", 1) for t in part], "t string, v int")
        rows.select(F.col("t").cast("timestamp").alias("t"), F.col("v").cast(S.MONEY).alias("v")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("t timestamp, v decimal(16,2)").parquet(source).withWatermark("t", "5 seconds")
        summary = tumbling_summary(stream, "t", (), ("v",))
        summary.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # 00:00:04 came after the window [0, 10) had closed at 00:00:20
    assert rows_of(spark.read.parquet(target), "stt", "apply_count") == [("2024-01-01 00:00:00", 1), ("2024-01-01 00:00:20", 2)]


def test_text_sink_and_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\ny\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    query = text_files(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), every="1 second")
    query.processAllAvailable()
    query.stop()
    assert rows_of(spark.read.text(str(tmp_path / "out"))) == [("x",), ("y",)]
    shown = console(stream)
    shown.processAllAvailable()
    shown.stop()
    assert shown.lastProgress is not None and shown.exception() is None
    jobs.count_job(spark, str(tmp_path / "in"), str(tmp_path / "n"), str(tmp_path / "count-checkpoint"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "n")).first()[0] == 2


def test_configuration_stream(spark, tmp_path):
    """Rows come before and after their table is configured, renamed and dropped."""
    log, config, tables = tmp_path / "log", tmp_path / "config", str(tmp_path / "dims")
    config.mkdir()

    def entry(sink, columns="id,name"):
        return {"source_table": "e", "sink_table": sink, "sink_family": "f", "sink_columns": columns, "sink_row_key": "id"}

    def run(n, changes, rows):
        (config / f"{n}.txt").write_text("\n".join(json.dumps({"op": o, "before": b, "after": a, "ts_ms": 10 * n + k}) for k, (o, b, a) in enumerate(changes)))
        write(log, f"{n}.txt", rows, 10 * n)
        jobs.config_job(spark, str(config), str(tmp_path / "layer"), tables, str(tmp_path / "c1"), available_now=True).awaitTermination()
        jobs.dimension_job(spark, str(log), str(tmp_path / "layer"), tables, str(tmp_path / "c2"), available_now=True).awaitTermination()

    run(0, [("c", None, entry("dim_a"))], [("e", "insert", {"id": "1", "name": "a"}), ("other", "insert", {"id": "7"})])
    assert rows_of(dimension_table(spark, f"{tables}/dim_a", ["id", "name"]).read()) == [("1", "1", "a")]
    run(1, [("u", entry("dim_a"), entry("dim_b"))], [("e", "insert", {"id": "2", "name": "b"})])
    assert not exists(spark, f"{tables}/dim_a")
    assert rows_of(dimension_table(spark, f"{tables}/dim_b", ["id", "name"]).read()) == [("2", "2", "b")]
    run(2, [("d", entry("dim_b"), None)], [("e", "insert", {"id": "3"})])
    assert not exists(spark, f"{tables}/dim_b")


def test_versions_survive_a_new_checkpoint(spark, tmp_path):
    """A new checkpoint counts its batches from 0 again; nothing is lost."""
    log, dims = tmp_path / "log", str(tmp_path / "dims")
    config = spark.createDataFrame([("e", "dim_e", "f", "id,name", "id")], S.TABLE_PROCESS)
    for n, name in enumerate(["a", "b"]):
        write(log, f"{n}.txt", [("e", "insert", {"id": name, "name": name})], 10 * n)
        jobs.dimension_job(spark, str(log), lambda: config, dims, str(tmp_path / "first"), available_now=True).awaitTermination()
    late = tmp_path / "late"
    write(late, "0.txt", [("e", "insert", {"id": "c", "name": "c"})], 99)
    jobs.dimension_job(spark, str(late), lambda: config, dims, str(tmp_path / "second"), available_now=True).awaitTermination()
    table = dimension_table(spark, f"{dims}/dim_e", ["id", "name"])
    assert rows_of(table.read(), "key") == [("a",), ("b",), ("c",)]
    before = table.batches(), table.bases()
    write(late, "1.txt", [("other", "insert", {"id": "d"})], 99)
    jobs.dimension_job(spark, str(late), lambda: config, dims, str(tmp_path / "second"), available_now=True).awaitTermination()
    assert (table.batches(), table.bases()) == before  # no change, no rewrite


def test_a_batch_that_runs_twice_is_read_once(spark, tmp_path):
    """By a stream that follows the layer, too."""
    layer, out = str(tmp_path / "layer"), str(tmp_path / "out")
    for _ in range(2):
        append_batch(spark.createDataFrame([("k", "p")], "kind string, payload string"), layer, 0)
        stream = spark.readStream.schema(jobs.PAYLOAD).parquet(layer)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_jobs_leave_the_session_alone(spark):
    before = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    session = jobs.job_session(spark)
    assert session.conf.get("spark.sql.session.timeZone") == S.SOURCE_ZONE == "+08:00"
    assert before == (spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.streaming.stateStore.providerClass"))
    # 16:55 in the sources' zone is one instant whatever the caller's zone is
    at = session.sql("SELECT '2024-08-06 16:55:00.123456' AS t").select(event_time(F.col("t")).cast("double").alias("at")).first()[0]
    assert at == 1722934500.123


def test_expiry_is_on_in_jobs_that_run_on():
    assert jobs._expiry(APPLICATION_CELLS, True, 30_000, 1) == {}
    assert jobs._expiry(APPLICATION_CELLS, False, 30_000, None) == dict.fromkeys(("add", "occupy", "produced"), 30_000)
    assert jobs.STASH_TTL_MS == 30_000 and jobs.TRIGGER == "10 seconds"


def test_snapshot_then_changes(spark, tmp_path):
    """Changes up to the fence are passed over, later ones hold; a start with a later
    snapshot keeps the first fence, so what came in between is not lost."""
    log, tables = tmp_path / "log", str(tmp_path / "tables")
    config = lambda: spark.createDataFrame([("person", "dim_person", "info", "id,name", "id")], S.TABLE_PROCESS)

    def person(id, name):
        return {"id": id, "name": name}

    def run(rows, fence):
        shot = spark.createDataFrame(rows, "id long, name string, more string")
        jobs.dimension_job(spark, str(log), config, tables, str(tmp_path / "checkpoint"), True, {"person": (shot, fence), "other": (shot, fence)}).awaitTermination()
        return rows_of(dimension_table(spark, f"{tables}/dim_person", ["id", "name"]).read(), "id", "name")

    # positions (4, 0, 0), (5, 0, 1), (6, 0, 2): the second is the fence
    write(log, "0.txt", [("person", "update", person("1", "old")), ("person", "delete", person("2", "b")), ("person", "update", person("3", "late"))], 4)
    first = run([(1, "new", "x"), (2, "b", "x"), (3, "c", "x"), (4, None, "x")], (5, 0, 1))
    assert first == [("1", "new"), ("2", "b"), ("3", "late"), ("4", "")]
    write(log, "1.txt", [("person", "delete", person("2", "b")), ("person", "insert", person("5", "e"))], 8)
    assert run([(9, "later", "x")], (100, 0, 0)) == [("1", "new"), ("3", "late"), ("4", ""), ("5", "e")]


def test_config_snapshot(spark, tmp_path):
    """Configuration rows come first and once; only later changes of it are applied."""
    log, layer, tables = tmp_path / "log", str(tmp_path / "layer"), str(tmp_path / "tables")
    log.mkdir()
    row = {"source_table": "a", "sink_table": "dim_a", "sink_family": "info", "sink_columns": "id", "sink_row_key": "id"}
    change = lambda op, before, after, at: json.dumps({"op": op, "before": before, "after": after, "ts_ms": at})
    (log / "0.txt").write_text("\n".join([change("d", row, None, 10), change("c", None, row | {"source_table": "b", "sink_table": "dim_b"}, 11)]))
    shot = spark.createDataFrame([tuple(row.values())], S.TABLE_PROCESS)
    for later in (10, 99):
        jobs.config_job(spark, str(log), layer, tables, str(tmp_path / "checkpoint"), True, (shot, later)).awaitTermination()
        assert exists(spark, f"{tables}/dim_a") and exists(spark, f"{tables}/dim_b")
    (log / "1.txt").write_text(change("d", row, None, 12))
    jobs.config_job(spark, str(log), layer, tables, str(tmp_path / "checkpoint"), True, (shot, 99)).awaitTermination()
    assert not exists(spark, f"{tables}/dim_a") and exists(spark, f"{tables}/dim_b")
