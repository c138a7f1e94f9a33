"""Keys of a bucket share a state and a call; a summary runs the fact jobs it reads."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql.streaming.stateful_processor import TimerValues
from shared_rows import SF, rows_of
from test_lifecycle import ADD, APPLY, OCCUPY, REPLY, STATUS, renamed

from leaselake.plans import queries
from leaselake.streaming import jobs
from leaselake.streaming.lifecycle import SLOTS, ApplicationLifecycle


class Map(dict):
    """A bucket's map; counts the calls that a real one would cost."""

    calls = 0

    def exists(self):
        Map.calls += 1
        return bool(self)

    def getValue(self, key):
        Map.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Map.calls += 1
        self[key] = value

    def removeKey(self, key):
        Map.calls += 1
        del self[key]


def machine(**ttl_ms):
    made, maps = ApplicationLifecycle("complete", ttl_ms), {}

    class Handle:
        def getMapState(self, name, *_, ttlDurationMs=None):
            maps[name] = (Map(), ttlDurationMs)
            return maps[name][0]

    made.init(Handle())
    return made, maps


def fed(made, changes, at=0):
    """Facts of one batch; a change is (application, change)."""
    rows = [(0, json.dumps([app, c[0], c[1], "1", str(n), "0", *renamed(c)[2].values()])) for n, (app, c) in enumerate(changes)]
    return [(r["kind"], json.loads(r["payload"])) for r in made.handleInputRows((0,), iter(rows), TimerValues(at, -1))]


def test_keys_of_a_bucket():
    """A first batch asks whether a map holds anything, not for each key, and writes a
    slot once; a later one finds what it needs."""
    made, maps = machine()
    Map.calls = 0
    found = fed(made, [(str(n), c) for c in (APPLY, STATUS, REPLY, ADD) for n in range(100)])
    assert [k for k, _ in found].count("audit_approve") == [k for k, _ in found].count("credit_add") == 100
    assert Map.calls <= 2 + SLOTS and len(maps["kept"][0]) <= SLOTS and not maps["early"][0]
    assert [k for k, _ in fed(made, [("7", OCCUPY), ("200", OCCUPY)])] == ["credit_occupy"]
    assert len(maps["early"][0]) == 1
    assert sorted(k for k, _ in fed(made, [("200", REPLY), ("200", APPLY), ("200", ADD)])) == ["audit_approve", "credit_add", "credit_occupy"]
    assert not maps["early"][0]


def test_rows_expire_each_by_themselves():
    made, maps = machine(add=15, occupy=15, produced=15, approval=1000, reply=1000, audit_man=1000)
    assert {name: ttl for name, (_, ttl) in maps.items()} == {"kept": 1000, "early": 15}
    again = (*ADD[:2], ADD[2] | {"id": "55"})
    assert fed(made, [("1", APPLY), ("1", ADD)], 0) == [] == fed(made, [("1", again)], 10)
    assert [(k, f["id"]) for k, f in fed(made, [("1", REPLY)], 20)] == [("audit_approve", "1"), ("credit_add", "55")]


def test_payloads_leave_nulls_out():
    made, _ = machine()
    ((kind, fact),) = fed(made, [("1", (*APPLY[:2], APPLY[2] | {"status": "20", "salesman_id": 'a "ü"\n'}))])
    assert kind == "audit_reject" and fact["salesman_id"] == 'a "ü"\n' and "audit_man_id" not in fact and None not in fact.values()


def test_a_summary_runs_the_jobs_it_reads(spark, monkeypatch):
    monkeypatch.setattr(queries, "_LAYERS", {})
    layer = queries._fact_layer(spark, SF, "audit_cancel")
    kinds = lambda: {p.name for p in Path(layer.removeprefix("file://")).iterdir() if not p.name.startswith(".")}
    assert kinds() == {"approved", "audit_cancel", "audit_reject"}
    before = rows_of(jobs.facts_of(spark, layer, "audit_cancel"), "id")
    assert queries._fact_layer(spark, SF, "audit_approve") == layer and "credit_add" not in kinds() and "audit_approve" in kinds()
    assert rows_of(jobs.facts_of(spark, layer, "audit_cancel"), "id") == before  # its job ran once


def test_expired_keys_of_a_slot_go():
    made, maps = machine(add=15, occupy=15, produced=15, approval=1000, reply=1000, audit_man=1000)
    fed(made, [(str(n), ADD) for n in range(1000)], 0)
    assert sum(len(json.loads(v[0])) for v in maps["early"][0].values()) == 1000
    fed(made, [(str(n), ADD) for n in range(2000, 2400)], 20)  # every slot is written again
    assert sum(len(json.loads(v[0])) for v in maps["early"][0].values()) == 400
