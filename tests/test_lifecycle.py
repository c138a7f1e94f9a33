"""The state machines: every transition, both arrival orders, both modes."""

from __future__ import annotations

import itertools
import json

import pytest

from leaselake.streaming.lifecycle import application_facts, application_step, contract_step, typed_facts
from pyspark.sql import functions as F

from leaselake.operators.projections import ROWS
from leaselake.streaming.jobs import job_session

STATUS = ("credit_facility_status", "insert", {"credit_facility_id": "1", "status": "5", "employee_id": "9"})
APPLY = ("credit_facility", "update", {"id": "1", "status": "16", "credit_amount": "100.00", "update_time": "t1", "salesman_id": "3"})
REPLY = ("reply", "insert", {"id": "7", "credit_facility_id": "1", "credit_amount": "90.00", "create_time": "t2", "irr": "0.05", "period": "12"})
CREDIT = {"id": "5", "credit_facility_id": "1", "credit_amount": "80.00", "create_time": "t3", "credit_occupy_time": "t4", "contract_produce_time": "t5", "contract_id": "6"}
ADD = ("credit", "insert", CREDIT | {"status": "1"})
OCCUPY = ("credit", "update", CREDIT | {"status": "2"})
PRODUCED = ("credit", "update", CREDIT | {"status": "3"})


def end(status: str):
    return ("credit_facility", "update", APPLY[2] | {"status": status})


def renamed(change):
    table, kind, data = change
    return table, kind, {name: data.get(field) for name, field, _ in ROWS[table]}


def run(changes, mode="complete"):
    state, out = {}, []
    for c in changes:
        out += list(application_step(state, *renamed(c), mode))
        state = json.loads(json.dumps({k: v for k, v in state.items() if v}))  # as it comes back from the store
    return out, state


def kinds(changes, mode="complete"):
    return [k for k, _ in run(changes, mode)[0]]


def test_in_order():
    found, _ = run([STATUS, APPLY, REPLY, ADD, OCCUPY, PRODUCED])
    assert [k for k, _ in found] == ["audit_approve", "credit_add", "credit_occupy", "contract_produced"]
    approve = found[0][1]
    assert (approve["audit_man_id"], approve["reply_id"], approve["apply_amount"], approve["reply_amount"], approve["approve_time"]) == ("9", "7", "100.00", "90.00", "t1")
    produced = found[3][1]
    assert (produced["id"], produced["credit_id"], produced["produced_time"], produced["reply_amount"]) == ("6", "5", "t5", "90.00")
    assert kinds([STATUS, APPLY, REPLY, ADD, OCCUPY, PRODUCED], "strict") == ["audit_approve", "credit_add"]


def test_complete_mode_ignores_order():
    wanted = sorted(kinds([APPLY, REPLY, ADD, OCCUPY, PRODUCED]))
    for order in itertools.permutations([APPLY, REPLY, ADD, OCCUPY, PRODUCED]):
        assert sorted(kinds(order)) == wanted


def test_reply_first_and_stash():
    assert kinds([REPLY, APPLY], "strict") == ["audit_approve"]
    assert kinds([APPLY, ADD, OCCUPY, PRODUCED, REPLY], "strict") == ["audit_approve", "credit_add", "credit_occupy", "contract_produced"]


def test_credit_before_approval():
    assert kinds([ADD, APPLY, REPLY]) == ["audit_approve", "credit_add"]
    assert kinds([ADD, APPLY, REPLY], "strict") == ["audit_approve"]


def test_officer_serves_once():
    found, state = run([STATUS, end("20"), end("21"), STATUS, APPLY, REPLY])
    assert [(k, f["audit_man_id"]) for k, f in found] == [("audit_reject", "9"), ("audit_cancel", None), ("audit_approve", "9")]
    assert found[0][1]["reject_time"] == "t1" and "audit_man" not in state


@pytest.mark.parametrize("mode", ["complete", "strict"])
def test_ignored(mode):
    other = [end("17"), ("credit_facility", "insert", APPLY[2]), ("credit_facility", "bootstrap-insert", APPLY[2]), ("credit_facility_status", "insert", STATUS[2] | {"status": "1"}), ("credit", "update", CREDIT | {"status": "4"})]
    assert run(other, mode) == ([], {})


def test_second_reply():
    assert kinds([APPLY, REPLY, REPLY]) == ["audit_approve"]
    assert kinds([APPLY, REPLY, REPLY], "strict") == ["audit_approve"] * 2


def test_reply_without_amount():
    bare = ("reply", "insert", REPLY[2] | {"credit_amount": None})
    assert kinds([APPLY, bare, ADD]) == ["audit_approve", "credit_add"]
    assert kinds([APPLY, bare, ADD], "strict") == ["audit_approve"]


FACT = {"id": "6", "credit_id": "5", "credit_facility_id": "1", "apply_amount": "100.00", "reply_amount": "90.00", "credit_amount": "80.00"}
SIGN = ("contract", "update", {"id": "6", "credit_id": "5", "status": "2", "signed_time": "s"})
START = ("contract", "update", {"id": "6", "credit_id": "5", "status": "3", "execution_time": "e"})


def test_contract_either_order():
    for order in itertools.permutations([("contract_produced", "insert", FACT), SIGN, START]):
        state, out = {}, []
        for c in order:
            out += list(contract_step(state, *(c if c[0] == "contract_produced" else renamed(c))))
        assert sorted(k for k, _ in out) == ["lease_execution", "lease_sign"]
        assert all(f["apply_amount"] == "100.00" and f["credit_facility_id"] == "1" for _, f in out)


def test_contract_ignored():
    state: dict = {}
    assert not list(contract_step(state, *renamed(("contract", "insert", SIGN[2]))))
    assert not list(contract_step(state, *renamed(("contract", "update", SIGN[2] | {"status": "1"}))))
    assert state == {}


def test_processor_in_batch(spark):
    rows = [("lease", t, k, 1, n, 0, d, None) for n, (t, k, d) in enumerate([STATUS, APPLY, REPLY, ADD, OCCUPY, PRODUCED])]
    log = spark.createDataFrame(rows, "database string, table string, type string, ts long, xid long, xoffset long, data map<string,string>, old map<string,string>")
    with pytest.raises(ValueError):
        application_facts(log)  # the session's state store is another
    out = application_facts(job_session(spark).createDataFrame(rows, log.schema))
    found = sorted(r["kind"] for r in out.collect())
    assert found == ["audit_approve", "contract_produced", "credit_add", "credit_occupy"]
    add = typed_facts(out, "credit_add").where(F.col("id") == "5").first()
    assert str(add["reply_amount"]) == "90.00"
