"""Sources, dimensions, facts, windows, enrichment and sinks on written rows."""

from __future__ import annotations

import json

import pytest
from shared_rows import rows_of
from pyspark.sql import functions as F

from leaselake import schemas as S
from leaselake.functions import blank_nulls, camel_case, event_time, json_lines, members, snake_case
from leaselake.operators import dimensions, facts
from leaselake.operators.enrich import with_officer_name
from leaselake.operators.projections import row_image, typed_rows
from leaselake.operators.windows import SUMMARIES, prepared, tumbling_summary
from leaselake.sources.changelog import current_config, fact_changes, parse_changes, parse_config, read_config_table, read_topic, read_values, require_source, split_contracts
from leaselake.streaming.sinks import append_batch, read_layer
from leaselake.streaming.tables import dimension_table

LOG = "database string, table string, type string, ts long, xid long, xoffset long, data map<string,string>, old map<string,string>"
SAMPLE = {
    "database": "lease",
    "table": "credit_facility_status",
    "type": "update",
    "ts": 1700000000,
    "xid": 11,
    "xoffset": 22,
    "data": {"id": 1, "status": 5, "credit_facility_id": 2, "employee_id": 3, "signatory_id": None},
    "old": {"employee_id": None},
}


def change(table, kind, data, old=None, at=0):
    return ("lease", table, kind, at, 0, 0, data, old)


def test_parse_and_quarantine(spark, tmp_path):
    lines = [json.dumps(SAMPLE), "", "not json", '{"type": "insert"}', "[1]"]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    good, bad = parse_changes(read_values(spark, str(tmp_path)))
    row = good.first()
    assert good.count() == 1 and row["data"]["id"] == "1" and row["xoffset"] == 22
    assert rows_of(bad) == [("[1]", "no table"), ("not json", "no JSON"), ('{"type": "insert"}', "no table")]


def test_messages_are_parsed_once(spark):
    values = spark.createDataFrame([(json.dumps(SAMPLE),), ("{cut",)], "value string")
    kept = fact_changes(parse_changes(values)[0])
    assert kept.count() == 1
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_missing_source(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        require_source(spark, path=str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        read_values(spark, str(tmp_path / "none"), streaming=True)
    with pytest.raises(FileNotFoundError):
        require_source(spark, table="no_such_table")


def test_fact_whitelist(spark):
    log = spark.createDataFrame(
        [
            change("credit", "insert", {"credit_facility_id": "1"}),
            change("credit", "insert", {"id": "1"}),
            change("credit_facility", "update", {"id": "1"}),
            change("contract", "update", {"credit_id": "1"}),
            change("contract", "update", {"id": "1"}),
            change("employee", "insert", {"id": "1"}),
            change("reply", "insert", None),
        ],
        LOG,
    )
    rest, contracts = split_contracts(fact_changes(log))
    assert rows_of(rest, "table") == [("credit",), ("credit_facility",)]
    assert rows_of(contracts, "table") == [("contract",)]


def test_event_time(spark):
    texts = ["2024-08-06 16:55:00.123456", "2024-08-06 16:55:00", "2024-13-06 16:55:00.000000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(event_time(F.col("t")), "HH:mm:ss.SSSSSS"))
    assert [r[0] for r in df.collect()] == ["16:55:00.123000", None, None, None]


def test_names_and_json(spark):
    assert snake_case("leaseOrganization") == "lease_organization" and camel_case("audit_man_id") == "auditManId"
    df = spark.createDataFrame([(1, None, "x")], "a_b int, gone string, c string")
    assert json_lines(df, camel_case).first()[0] == '{"aB":1,"c":"x"}'
    assert blank_nulls(df, "gone").first()["gone"] == ""
    assert spark.range(1).select(members(F.lit("a, b,c"))).first()[0] == ["a", "b", "c"]


def test_typed_rows(spark):
    data = {"id": "1", "credit_amount": "10.005", "status": "16", "update_time": "2024-01-01 00:00:00.000000", "extra": "x"}
    row = typed_rows(spark.createDataFrame([change("credit_facility", "update", data)], LOG), "credit_facility").first()
    assert (row["id"], str(row["apply_amount"]), row["lease_organization"]) == ("1", "10.01", None)


def test_config_changes(spark):
    def line(op, at, after, before=None):
        return (json.dumps({"op": op, "ts_ms": at, "after": after, "before": before}),)

    one = {"source_table": "a", "sink_table": "dim_a", "sink_columns": "id"}
    lines = [line("r", 1, one), line("u", 2, one | {"sink_columns": "id,name"}, one), line("c", 1, one | {"source_table": "b"}), line("d", 3, None, one | {"source_table": "b"})]
    config = current_config(parse_config(spark.createDataFrame(lines, "value string")))
    assert rows_of(config, "source_table", "sink_columns") == [("a", "id,name")]


def test_config_creates_and_drops(spark):
    def row(op, at, after, before):
        return (before, after, op, at)

    old, new = ("a", "dim_test_a", "f", "id, name", "id"), ("a", "dim_test_b", "f", "id", "id")
    def actions(*rows):
        return sorted(dimensions.config_actions(spark.createDataFrame(rows, S.CONFIG_ENVELOPE)))

    assert actions(row("u", 2, new, old), row("c", 1, old, None), row("u", 3, new, new)) == [("dim_test_a", None, True), ("dim_test_b", ["id"], False)]
    assert actions(row("u", 2, new, old), row("d", 4, None, new)) == [("dim_test_a", None, True), ("dim_test_b", None, True)]
    assert actions(row("c", 5, old, None), row("d", 4, None, old)) == [("dim_test_a", ["id", "name"], True)]
    assert actions(row("c", 5, old, None), row("d", 5, None, old)) == [("dim_test_a", ["id", "name"], True)]  # of one time: deletes first
    with pytest.raises(ValueError):
        dimensions.column_names(" ")


def test_kafka_and_jdbc_options(spark):
    """What the readers ask for, against stubs: there is no broker and no database."""
    asked = {}

    class Reader:
        def format(self, name):
            asked["format"] = name
            return self

        def option(self, name, value):
            asked[name] = value
            return self

        def load(self):
            return spark.createDataFrame([(bytearray(b'{"a":1}'),), (bytearray(b""),), (None,)], "value binary")

        def jdbc(self, url, table, properties):
            asked.update(url=url, dbtable=table, **properties)
            return spark.createDataFrame([("x", *S.DIMENSION_CONFIG[0])], "extra string, source_table string, sink_table string, sink_family string, sink_columns string, sink_row_key string")

    class Stub:
        read = readStream = Reader()

    assert rows_of(read_topic(Stub(), "broker:9092", "topic")) == [('{"a":1}',)]
    assert asked == {"format": "kafka", "kafka.bootstrap.servers": "broker:9092", "subscribe": "topic", "startingOffsets": "earliest"}
    found = read_config_table(Stub(), "jdbc:mysql://db/config", "table_process", {"user": "reader"})
    assert found.columns == S.TABLE_PROCESS.fieldNames() and asked["dbtable"] == "table_process" and asked["user"] == "reader"


def test_delete_takes_old_values(spark):
    log = spark.createDataFrame([change("e", "delete", {"id": "1", "name": "new"}, {"name": "old"}), change("e", "delete", None, {"id": "2"}), change("e", "delete", {"id": "3"})], LOG)
    found = row_image(log).select(F.col("row")["id"], F.col("row")["name"])
    assert rows_of(found) == [("1", "old"), ("2", None), ("3", None)]


def test_dimension_upkeep(spark, tmp_path):
    config = spark.createDataFrame([("e", "dim_e", "f", "id, name", "id")], S.TABLE_PROCESS)
    first = [change("e", "bootstrap-start", {}), change("e", "bootstrap-insert", {"id": "1", "name": None, "x": "y"}), change("e", "insert", {"id": "2", "name": "b"}), change("other", "insert", {"id": "9"}), change("e", "insert", {"name": "no key"})]
    second = [change("e", "delete", {"id": "1"}, at=1), change("e", "insert", {"id": "1", "name": "again"}, at=2), change("e", "update", {"id": "2", "name": "c"}, at=1), change("e", "delete", {"id": "2"}, at=3)]
    table = dimension_table(spark, str(tmp_path / "dim_e"), ["id", "name"])
    for n, log in enumerate([first, second, second]):  # the last batch runs twice
        newest = dimensions.newest_per_key(dimensions.dimension_changes(spark.createDataFrame(log, LOG), config))
        table.append(dimensions.dimension_rows(newest, "id, name"), min(n, 1))
        if n == 0:
            assert rows_of(table.read()) == [("1", "1", ""), ("2", "2", "b")]
    assert rows_of(table.read()) == [("1", "1", "again")]
    assert [n for n, _ in table.batches()] == [0, 1]
    wider = dimension_table(spark, str(tmp_path / "dim_e"), ["id", "name", "later"])  # older rows do not have the column
    assert rows_of(wider.read()) == [("1", "1", "again", "")]


def test_flattened_hierarchy(spark):
    tree = spark.createDataFrame([(1, "top", None), (2, "mid", 1), (3, "leaf", 2), (4, "orphan", 99), (5, "root", None)], "id int, n string, up int")
    flat = dimensions.flattened(tree, "n", "up", "d")
    assert flat.columns == ["d3_id", "d3_name", "d2_id", "d2_name", "d1_id", "d1_name"]
    found = {r[0]: tuple(r)[1:] for r in flat.collect()}
    assert found[3] == ("leaf", 2, "mid", 1, "top")
    assert found[4] == ("orphan", 99, None, None, None)
    assert found[5] == ("root", None, None, None, None)


def test_officer_as_of(spark):
    apps = spark.createDataFrame([("1", "20", 5), ("1", "16", 9), ("2", "16", 1), ("1", "17", 6), ("3", "21", 2)], "id string, status string, pos int")
    seen = spark.createDataFrame([("1", "5", "a", 1), ("1", "6", "b", 4), ("1", "20", "c", 7), ("1", "1", "z", 8), ("2", "5", "late", 3)], "credit_facility_id string, status string, employee_id string, pos int")
    assert rows_of(facts.with_officer(apps, seen), "id", "status", "audit_man_id") == [("1", "16", "c"), ("1", "20", "b"), ("2", "16", None), ("3", "21", None)]


def test_window_edges_and_nulls(spark):
    rows = [("2024-01-01 00:00:00", "k", "1.00"), ("2024-01-01 00:00:09", None, None), ("2024-01-01 00:00:10", "k", "2.50"), ("2024-01-01 23:59:59", "k", "1.00")]
    df = spark.createDataFrame(rows, "t string, k string, a string").select(F.col("t").cast("timestamp").alias("t"), "k", F.col("a").cast(S.MONEY).alias("a"))
    out = tumbling_summary(df, "t", ("k",), ("a",))
    found = [(r["stt"], r["edt"], r["cur_date"], r["k"], r["apply_count"], r["a"] and str(r["a"])) for r in out.orderBy("stt", "k").collect()]
    assert found == [
        ("2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01", None, 1, None),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01", "k", 1, "1.00"),
        ("2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01", "k", 1, "2.50"),
        ("2024-01-01 23:59:50", "2024-01-02 00:00:00", "2024-01-01", "k", 1, "1.00"),
    ]


def test_summary_specs(spark):
    assert len(SUMMARIES) == 11
    assert [n for n, s in SUMMARIES.items() if s.delay != "5 seconds"] == ["ind_org_salesman_cancel"]
    rows = spark.createDataFrame([("t", "1", None), ("t", None, None)], "cancel_time string, audit_man_id string, apply_amount string")
    assert prepared(rows, SUMMARIES["audit_man_cancel"]).count() == 1


def test_enrichment_keeps_rows(spark):
    summary = spark.createDataFrame([("a", "b", "c", "1", 2), ("a", "b", "c", "9", 3)], "stt string, edt string, cur_date string, audit_man_id string, apply_count int")
    employees = spark.createDataFrame([("1", "Ann")], "id string, name string")
    assert rows_of(with_officer_name(summary, employees), "audit_man_id", "audit_man_name") == [("1", "Ann"), ("9", None)]


def test_append_batch_once(spark, tmp_path):
    path = str(tmp_path / "layer")
    for batch in (0, 1, 1):
        append_batch(spark.createDataFrame([(batch,)], "v int"), path, batch)
    assert rows_of(read_layer(spark, path)) == [(0,), (1,)]
