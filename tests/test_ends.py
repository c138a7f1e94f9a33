"""Ends of applications with their officers, batch by batch, and the topics of the log."""

from __future__ import annotations

import json

from shared_rows import rows_of

from leaselake import schemas as S
from leaselake.plans import queries
from leaselake.plans.change_log import lease_log
from leaselake.streaming import jobs
from leaselake.streaming.joins import OFFICER, WAITING, application_ends

SF = "/root/testdata/sf0.001"


def change(table, at, **data):
    kind = "update" if table == "credit_facility" else "insert"
    return {"database": "lease", "table": table, "type": kind, "ts": at, "xid": 0, "xoffset": 0, "data": {k: str(v) for k, v in data.items() if v is not None}, "old": None}


def seen(app, officer, at, status=5):
    return change("credit_facility_status", at, credit_facility_id=app, status=status, employee_id=officer)


def end(app, status, at):
    return change("credit_facility", at, id=app, status=status, update_time=f"2024-01-01 00:00:{at:02d}")


def run(spark, changes, waiting, now=100, ttl=None):
    """(kind, application, officer) of the ends, the officers that wait afterwards."""
    held = {r[0]: r for r in waiting}
    rows = application_ends(spark.createDataFrame(changes, S.ENVELOPE), spark.createDataFrame(waiting, WAITING), now, ttl).collect()
    facts = [(r["kind"], f["id"], f.get("audit_man_id")) for r in rows if r["kind"] != OFFICER for f in [json.loads(r["payload"])]]
    for r in rows:
        if r["kind"] == OFFICER:
            c = json.loads(r["payload"])
            held.pop(c["id"]) if c["deleted"] else held.__setitem__(c["id"], (c["id"], c.get("employee_id"), c["since"]))
    return sorted(facts, key=str), sorted(held.values())


def test_an_officer_serves_one_end(spark):
    batch = [end(1, 16, 5), seen(1, "a", 3), seen(1, "b", 4), seen(1, "x", 4, status=1), end(1, 20, 7), seen(1, "c", 6), end(2, 21, 9), end(3, 21, 1), end(3, 20, 2), seen(3, "d", 0), end(4, 5, 1)]
    facts, waiting = run(spark, batch, [])
    assert facts == [("approved", "1", "b"), ("audit_cancel", "2", None), ("audit_cancel", "3", "d"), ("audit_reject", "1", "c"), ("audit_reject", "3", None)]
    assert waiting == []


def test_officers_wait_for_later_batches(spark):
    facts, waiting = run(spark, [seen(1, "a", 3), seen(2, None, 3), end(3, 21, 2), seen(3, "z", 4)], [], now=10)
    assert facts == [("audit_cancel", "3", None)] and waiting == [("1", "a", 10), ("2", None, 10), ("3", "z", 10)]
    facts, again = run(spark, [end(1, 16, 1), end(1, 20, 2), seen(3, "y", 1)], waiting, now=20)
    assert facts == [("approved", "1", "a"), ("audit_reject", "1", None)] and again == [("2", None, 10), ("3", "y", 20)]
    facts, last = run(spark, [end(3, 21, 9), end(2, 21, 9)], again, now=30, ttl=15)  # the officer of 2 is too old
    assert facts == [("audit_cancel", "2", None), ("audit_cancel", "3", "y")] and last == []


def test_a_job_reads_its_topic(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "_LAYERS", {})
    write = queries._log_files
    monkeypatch.setattr(queries, "_log_files", lambda spark, sf_dir, *tables: made.append(tables) or write(spark, sf_dir, *tables))
    queries._fact_layer(spark, SF, "audit_reject")
    assert made == [jobs.JOINED_TABLES["ends"]]
    whole = lease_log(spark, SF)
    topics = [lease_log(spark, SF, tables) for tables in queries.TOPICS.values()]
    columns = ("table", "type", "ts", "xid", "xoffset", "data")
    assert rows_of(whole, *columns) == sorted((r for t in topics for r in rows_of(t, *columns)), key=lambda r: tuple((x is not None, str(x)) for x in r))
