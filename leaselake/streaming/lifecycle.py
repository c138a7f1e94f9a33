"""Keyed state machines that assemble facts from changes in any order.

The rules are plain functions of a small state, so they are tested without Spark;
the processors keep that state in maps of Spark's state store, by bucket, in
cells with an expiry of their own: a value for an officer, an approval, a reply, and a
list for the early rows of each step, where every row expires by itself. Two modes:

* ``complete``: what the facts mean. Approvals are kept, credit rows wait for
  them, and every step of a credit is a fact, whatever came first.
* ``strict``: the narrower rules. A credit row without an approval is dropped, and
  each credit fact that is sent at once uses its approval up.

``joins`` has the complete rules as joins, without a machine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leaselake import schemas as S
from leaselake.operators.projections import ROWS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Steps of a credit: the cell of its early rows, and the fact.
STEPS = {"add": "credit_add", "occupy": "credit_occupy", "produced": "contract_produced"}
#: How long early rows wait, and how long approvals and produced contracts are kept,
#: in a job that runs on (400 days, longer than a lease takes to start).
STASH_TTL_MS = 30_000
KEEP_TTL_MS = 400 * 86_400_000
#: Buckets of applications, or credits, that share a state; a job's state depends on it.
BUCKETS = 4096
#: Slots of a bucket, whose keys are read and written together: a call to the state
#: costs more than a hundred keys' text.
SLOTS = 64


def _names(table: str) -> list[str]:
    return [name for name, *_ in ROWS[table]]


REPLIED = ("reply_id", "reply_amount", "reply_time", "irr", "period")
#: Facts leave a machine as their topics have them.
OUT = "kind string, payload string"
#: An application that was approved, with its officer, before its reply is known.
APPROVED = "approved"
KINDS = S.FACTS | {APPROVED: [c for c in S.FACTS["audit_approve"] if c not in REPLIED]}
#: Cells: whether a list, columns, and whether its rows came early.
_CREDIT_ROWS = (True, _names("credit"), True)
APPLICATION_CELLS = {
    "audit_man": (False, ["employee_id"], False),
    "approval": (False, [*_names("credit_facility"), "audit_man_id", "approve_time", *REPLIED, "replied"], False),
    "reply": (False, _names("reply"), False),
    "add": _CREDIT_ROWS,
    "occupy": _CREDIT_ROWS,
    "produced": _CREDIT_ROWS,
}
CONTRACT_CELLS = {
    "produced": (False, ["credit_facility_id", "apply_amount", "reply_amount", "credit_amount"], False),
    "signed": (False, _names("contract"), True),
    "execution": (False, _names("contract"), True),
}

Fact = tuple[str, dict]


def _step_of(kind: str, row: dict) -> str | None:
    if kind == "insert":
        return "add"
    return {S.CREDIT_OCCUPIED: "occupy", S.CREDIT_PRODUCED: "produced"}.get(row["status"])


def _credit_fact(step: str, row: dict, approval: dict) -> Fact:
    fact = STEPS[step]
    full = row | {"apply_amount": approval["apply_amount"], "reply_amount": approval["reply_amount"]}
    if step == "produced":
        full |= {"credit_id": row["id"], "id": row["contract_id"]}
    return fact, {c: full.get(c) for c in S.FACTS[fact]}


def _filled(approval: dict, reply: dict) -> dict:
    return approval | {c: reply[c] for c in REPLIED} | {"replied": "yes"}


def _replied(approval: dict, mode: str) -> bool:
    return approval.get("replied") is not None and (mode == "complete" or approval["reply_amount"] is not None)


def _flush(state: dict, approval: dict) -> Iterator[Fact]:
    for step in STEPS:
        for row in state.pop(step, None) or []:
            yield _credit_fact(step, row, approval)


def application_step(state, table: str, kind: str, row: dict, mode: str = "complete") -> Iterator[Fact]:
    """Facts that one change of an application's tables gives; changes ``state``, a
    dictionary of cells or what behaves like one. ``row`` has the names of ``ROWS``."""
    if table == "credit_facility_status":
        officer_step(state, row)
    elif table == "credit_facility" and kind == "update":
        yield from _application(state, row, mode)
    elif table == "reply":
        approval = state.get("approval")
        if approval is None:
            state["reply"] = row
        elif mode == "strict" or approval.get("replied") is None:
            yield from _approve(state, _filled(approval, row), mode)
    elif table == "credit":
        step, approval = _step_of(kind, row), state.get("approval")
        if step is None or (approval is None and mode == "strict"):
            return
        if approval is None or not _replied(approval, mode):
            early = state.get(step) or []
            state[step] = [row] if mode == "strict" else [*early, row]
        else:
            yield _credit_fact(step, row, approval)
            if mode == "strict":
                state.pop("approval")


def officer_step(state, row: dict) -> None:
    if row["status"] in S.OFFICER_STATUSES:
        state["audit_man"] = {"employee_id": row["employee_id"]}


def ended(state, row: dict) -> Fact | None:
    """An application's end with its officer, whom it uses up: ``approved``, or the
    fact of a rejection or a cancellation."""
    status = row["status"]
    if status not in (S.APPROVED, S.REJECTED, S.CANCELLED):
        return None
    fact, time = {S.APPROVED: (APPROVED, "approve_time"), S.REJECTED: ("audit_reject", "reject_time"), S.CANCELLED: ("audit_cancel", "cancel_time")}[status]
    officer = state.pop("audit_man", None)
    return fact, row | {"audit_man_id": officer["employee_id"] if officer else None, time: row["update_time"]}


def _application(state, row: dict, mode: str) -> Iterator[Fact]:
    found = ended(state, row)
    if found is None:
        return
    fact, full = found
    if fact == APPROVED:
        reply = state.pop("reply", None)
        if reply is None:
            state["approval"] = full
        else:
            yield from _approve(state, _filled(full, reply), mode)
        return
    state.pop("approval", None)
    yield fact, {c: full.get(c) for c in S.FACTS[fact]}


def _approve(state: dict, approval: dict, mode: str) -> Iterator[Fact]:
    state["approval"] = approval
    yield "audit_approve", {c: approval.get(c) for c in S.FACTS["audit_approve"]}
    yield from _flush(state, approval)


def contract_step(state, table: str, kind: str, row: dict) -> Iterator[Fact]:
    """Facts from a produced contract (``table`` contract_produced, ``row`` that
    fact) or from a change of a contract."""
    if table == "contract_produced":
        if any(state.get(s) is None for s in ("signed", "execution")):
            state["produced"] = {c: row.get(c) for c in CONTRACT_CELLS["produced"][1]}
        for side in ("signed", "execution"):
            early = state.pop(side, None)
            if early is not None:
                yield _lease_fact(side, early, row)
        return
    side = {S.CONTRACT_SIGNED: "signed", S.CONTRACT_STARTED: "execution"}.get(row["status"])
    if kind != "update" or side is None:
        return
    produced = state.get("produced")
    if produced is None:
        state[side] = row
    else:
        yield _lease_fact(side, row, produced)


def _lease_fact(side: str, row: dict, produced: dict) -> Fact:
    fact = "lease_sign" if side == "signed" else "lease_execution"
    full = row | {c: produced.get(c) for c in ("credit_facility_id", "apply_amount", "reply_amount", "credit_amount")}
    return fact, {c: full.get(c) for c in S.FACTS[fact]}


class _Cells:
    """An application's or credit's cells as a dictionary: read when first asked for,
    written at the end if they changed. They stand in two maps of the bucket, of what
    is kept and of early rows. Each row has an expiry of its own, so rows added to a
    list leave those before them theirs."""

    def __init__(self, bucket: _Bucket, key: str):
        self.bucket, self.key = bucket, key
        self.now: dict = {}
        self.asked: set[str] = set()
        self.held: dict[bool, dict] = {}  # by map: cell to [expiry, values] of its rows

    def _stored(self, name: str):
        is_list, columns, early = self.bucket.cells[name]
        if early not in self.held:
            self.held[early] = self.bucket.read(early, self.key)
        rows = [dict(zip(columns, values, strict=True)) for _, values in self.held[early].get(name, [])]
        return rows if is_list and rows else rows[0] if rows else None

    def get(self, name: str, default=None):
        if name not in self.now:
            self.now[name] = self._stored(name)
            self.asked.add(name)
        return default if self.now[name] is None else self.now[name]

    def pop(self, name: str, default=None):
        found = self.get(name, default)
        self.now[name] = None
        return found

    def __setitem__(self, name: str, value) -> None:
        self.now[name] = value

    def save(self) -> None:
        changed: dict[bool, dict] = {}
        for name, value in self.now.items():
            is_list, columns, early = self.bucket.cells[name]
            before = self._stored(name)
            if value == before and (name in self.asked or value is None):
                continue
            after = changed.setdefault(early, dict(self.held[early]))
            old = after.pop(name, [])
            if value:
                rows = value if is_list else [value]
                kept = old if is_list and rows[: len(old)] == (before or []) else []
                end = self.bucket.expiry(name)
                after[name] = kept + [[end, [r.get(c) for c in columns]] for r in rows[len(kept) :]]
        for early, after in changed.items():
            if after != self.held[early]:
                self.bucket.write(early, self.key, after)


class _Bucket:
    """The maps of one bucket, by whether their rows are early ones: slot to the cells of
    its keys, as text. A slot is read when one of its keys asks and written once a
    batch, so calls are bounded whatever the keys; a map that holds nothing yet, as in
    a first batch, is asked once."""

    def __init__(self, maps: dict, cells: dict, ttl_ms: dict[str, int], now_ms: int):
        self.maps, self.cells, self.ttl_ms, self.now_ms = maps, cells, ttl_ms, now_ms
        self.filled: dict[bool, bool] = {}
        self.slots: dict[tuple[bool, str], dict] = {}
        self.stored: set[tuple[bool, str]] = set()
        self.changed: set[tuple[bool, str]] = set()

    def expiry(self, name: str) -> int | None:
        return self.now_ms + self.ttl_ms[name] if name in self.ttl_ms else None

    def _slot(self, early: bool, key: str) -> tuple[bool, str]:
        at = early, str(crc32(key.encode("utf-8", "surrogatepass")) % SLOTS)
        if at not in self.slots:
            if early not in self.filled:
                self.filled[early] = self.maps[early].exists()
            found = self.maps[early].getValue((at[1],)) if self.filled[early] else None
            if found is not None:
                self.stored.add(at)
            self.slots[at] = {k: live for k, cells in json.loads(found[0]).items() if (live := self._live(cells))} if found is not None else {}
        return at

    def _live(self, cells: dict) -> dict:
        if not self.ttl_ms:
            return cells
        live = {name: [r for r in rows if r[0] is None or r[0] > self.now_ms] for name, rows in cells.items()}
        return {name: rows for name, rows in live.items() if rows}

    def read(self, early: bool, key: str) -> dict:
        return self.slots[self._slot(early, key)].get(key, {})

    def write(self, early: bool, key: str, cells: dict) -> None:
        at = self._slot(early, key)
        self.changed.add(at)
        if cells:
            self.slots[at][key] = cells
        else:
            self.slots[at].pop(key, None)

    def flush(self) -> None:
        for at in self.changed:
            early, slot = at
            if self.slots[at]:
                self.maps[early].updateValue((slot,), (_text(self.slots[at]),))
            elif at in self.stored:
                self.maps[early].removeKey((slot,))


class _Machine(StatefulProcessor):
    """Runs a step function over the changes of each key in log order. The keys of a
    bucket share one state and one call, since what a call costs outweighs a key's few
    rows. ``ttl_ms``: how long a cell's rows are kept, by cell."""

    cells: dict[str, tuple[bool, list[str], bool]]

    def __init__(self, ttl_ms: dict[str, int] | None = None):
        self.ttl_ms = ttl_ms or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {}
        for early in sorted({early for _, _, early in self.cells.values()}):
            own = [self.ttl_ms.get(name) for name, cell in self.cells.items() if cell[2] == early]
            # a map's entry goes with the last of its rows
            self.maps[early] = handle.getMapState("early" if early else "kept", "slot string", "cells string", ttlDurationMs=None if None in own else max(own))
        self.out = Row("kind", "payload")

    def step(self, state, table: str, kind: str, row: dict) -> Iterator[Fact]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bucket = _Bucket(self.maps, self.cells, self.ttl_ms, timerValues.getCurrentProcessingTimeInMs())
        changes = [json.loads(r[1]) for r in rows]
        changes.sort(key=lambda c: (c[0], int(c[3]), int(c[4]), int(c[5])))
        for name, own in groupby(changes, key=itemgetter(0)):
            state = _Cells(bucket, name)
            for _, table, kind, _, _, _, *row in own:
                for found, fact in self.step(state, table, kind, dict(zip(_OF[table], row, strict=True))):
                    yield self.out(found, _text({c: fact[c] for c in KINDS[found] if fact.get(c) is not None}))
            state.save()
        bucket.flush()

    def close(self) -> None:
        pass


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_OF = {table: _names(table) for table in ROWS} | {"contract_produced": CONTRACT_CELLS["produced"][1]}


class ApplicationLifecycle(_Machine):
    """State of an application: officer, approval and reply; early credit rows."""

    cells = APPLICATION_CELLS

    def __init__(self, mode: str = "complete", ttl_ms: dict[str, int] | None = None):
        if mode not in ("complete", "strict"):
            raise ValueError(f"no mode {mode}")
        super().__init__(ttl_ms)
        self.mode = mode

    def step(self, state, table, kind, row):
        return application_step(state, table, kind, row, self.mode)


class ContractLifecycle(_Machine):
    """State of a credit: its produced contract, and early contract steps."""

    cells = CONTRACT_CELLS

    def step(self, state, table, kind, row):
        return contract_step(state, table, kind, row)


def expiry(cells: dict, early_ms: int | None, kept_ms: int | None) -> dict[str, int]:
    """Expiry of each cell: of early rows, and of what is kept; None is for ever."""
    wanted = {name: early_ms if early else kept_ms for name, (_, _, early) in cells.items()}
    return {name: ms for name, ms in wanted.items() if ms}


def _keyed(changes: DataFrame, key: Column) -> DataFrame:
    """Changes as the machines read them: ``row`` has the fields of ``ROWS`` in order."""
    fields = [F.when(F.col("table") == t, F.array(*[F.col("data")[f] for _, f, _ in row])) for t, row in ROWS.items()]
    return changes.select(key.alias("key"), "table", "type", *S.POSITION, F.coalesce(*fields).alias("row"))


def with_payload(facts: DataFrame) -> DataFrame:
    """``kind, payload``: the fact's columns as JSON, as its topic has them."""
    texts = [F.when(F.col("kind") == k, F.to_json(F.struct(*columns))) for k, columns in KINDS.items() if set(columns) <= set(facts.columns)]
    return facts.select("kind", F.coalesce(*texts).alias("payload"))


def _run(keyed: DataFrame, machine: StatefulProcessor, buckets: int = BUCKETS) -> DataFrame:
    """The session of ``keyed`` must name RocksDB as its state store: the jobs work in
    a session of their own that does, and no other is changed."""
    spark = keyed.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    spark.streams.active  # noqa: B018  a batch needs the state store's coordinator too
    mode = "ProcessingTime" if machine.ttl_ms else "None"
    # a change is one text, since what crosses to Python and back costs by cell
    place = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in S.POSITION]
    cells = F.concat(F.array("key", "table", "type", *place), "row")
    dealt = keyed.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), F.to_json(cells).alias("change"))
    return dealt.groupBy("bucket").transformWithState(machine, OUT, "Append", mode)


def _application_key() -> Column:
    return F.when(F.col("table") == "credit_facility", F.col("data")["id"]).otherwise(F.col("data")["credit_facility_id"])


def application_facts(changes: DataFrame, mode: str = "complete", ttl_ms: dict[str, int] | None = None) -> DataFrame:
    """``kind, payload`` of the facts of applications and credits, from the fact
    changes (without contracts) of a stream or a table."""
    return _run(_keyed(changes.where(F.col("table") != "contract"), _application_key()), ApplicationLifecycle(mode, ttl_ms))


def contract_facts(changes: DataFrame, produced: DataFrame, ttl_ms: dict[str, int] | None = None) -> DataFrame:
    """``kind, payload`` of lease facts from contract changes and the payloads of
    contract_produced facts, in either order."""
    contracts = _keyed(changes.where(F.col("table") == "contract"), F.col("data")["credit_id"])
    first = F.lit(0).cast("long")
    names = ["credit_id", *CONTRACT_CELLS["produced"][1]]
    known = produced.select(F.from_json("payload", ", ".join(f"{c} string" for c in names)).alias("p"))
    row = F.array(*[F.col("p")[c] for c in CONTRACT_CELLS["produced"][1]]).alias("row")
    sides = known.select(F.col("p.credit_id").alias("key"), F.lit("contract_produced").alias("table"), F.lit("insert").alias("type"), *[first.alias(c) for c in S.POSITION], row)
    return _run(contracts.unionByName(sides), ContractLifecycle(ttl_ms))


def typed_facts(facts: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind as columns; times stay strings as in the source."""
    columns = KINDS[kind]
    schema = ", ".join(f"{c} string" for c in columns)
    types = {"irr": S.RATE, "period": "long"} | {c: S.MONEY for c in columns if c.endswith("_amount")}
    # inlined, so that no filter is moved below the parser and parses once more
    parsed = facts.where(F.col("kind") == kind).select(F.inline(F.array(F.from_json("payload", schema))))
    return parsed.select([F.col(c).cast(types.get(c, "string")).alias(c) for c in columns])
