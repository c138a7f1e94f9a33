"""The complete rules as stream-stream joins: facts whose order does not matter.

An approval waits for its reply and a credit's step for its approval in the state of
a join, in the JVM. With ``patience`` both sides have a watermark and rows pair up to
that far apart in event time, after which the state lets them go; without, as in
bounded runs, everything waits. Of several replies to one approval, and of a step
that is delivered twice, one counts: the first that comes.

Bounded runs pair what a batch brings with what the layers already hold (``met``), by
one shuffle a batch and without a state: what waits for its other side is all that they
keep, and each batch writes it anew.

Ends of applications do depend on the order: each takes the officer who came last. A
batch is put in order by application, with the officers left over from those before it
in a keyed table, which stands for state; it is read whole by each batch, and takes only what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaselake import schemas as S
from leaselake.functions import event_time
from leaselake.operators.projections import ROWS
from leaselake.streaming.lifecycle import APPROVED, KINDS, REPLIED, STEPS, with_payload

#: Changes to the officers that wait for their application's end.
OFFICER = "officer"
WAITING = "id string, employee_id string, since long"
#: What waits for its other side in bounded runs.
EARLY_REPLY, EARLY_APPROVAL, EARLY_CREDIT = "early_reply", "early_approval", "early_credit"


def _rows(changes: DataFrame, table: str) -> DataFrame:
    cells = [F.col("data")[field].alias(name) for name, field, _ in ROWS[table]]
    return changes.where(F.col("table") == table).select("type", *cells)


def _facts(layer: DataFrame, kind: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in KINDS[kind])
    return layer.select(F.inline(F.array(F.from_json("payload", schema))))


def _paired(left: DataFrame, right: DataFrame, key: str, times: tuple[str, str], patience: str | None, once: list[str]) -> DataFrame:
    """Inner join of two streams by ``key`` (of the left) and ``_key``, one row for each
    value of ``once``."""
    same = left[key] == right["_key"]
    if patience is None:
        return left.join(right, same).dropDuplicates(once)
    left = left.withColumn("_at", event_time(F.col(times[0]))).withWatermark("_at", patience)
    right = right.withColumn("_other", event_time(F.col(times[1]))).withWatermark("_other", patience)
    apart = F.expr(f"_other BETWEEN _at - INTERVAL {patience} AND _at + INTERVAL {patience}")
    both = left.join(right, (left[key] == right["_key"]) & apart).drop("_other")
    return both.dropDuplicatesWithinWatermark(once)


def application_ends(changes: DataFrame, waiting: DataFrame, now_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """``kind, payload`` of a batch's ends of applications with their officers, as the
    lifecycle gives them, and of kind ``OFFICER`` the changes to ``waiting(id,
    employee_id, since)``, the officers that no end has used up: those that came, went,
    or are older than ``ttl_ms`` at ``now_ms``. One shuffle by application."""
    c = F.col
    status, end = c("table") == "credit_facility_status", c("table") == "credit_facility"
    counts = status & c("data")["status"].isin(*S.OFFICER_STATUSES)
    ends = end & (c("type") == "update") & c("data")["status"].isin(S.APPROVED, S.REJECTED, S.CANCELLED)
    image = F.struct(*[c("data")[field].alias(name) for name, field, _ in ROWS["credit_facility"]])
    came = changes.where(counts | ends).select(
        F.when(end, c("data")["id"]).otherwise(c("data")["credit_facility_id"]).alias("key"),
        F.struct(F.lit(1).alias("new"), *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in S.POSITION]).alias("pos"),
        end.alias("end"),
        F.when(status, F.struct(c("data")["employee_id"].alias("employee_id"))).alias("officer"),
        F.when(end, image).alias("row"),
    )
    fresh = F.lit(True) if ttl_ms is None else c("since") > now_ms - ttl_ms
    first = F.struct(F.lit(0).alias("new"), *[F.lit(0).cast("long").alias(x) for x in S.POSITION]).alias("pos")
    held = waiting.select(c("id").alias("key"), first, F.lit(False).alias("end"), F.when(fresh, F.struct("employee_id")).alias("officer"), F.lit(None).cast(came.schema["row"].dataType).alias("row"))
    along = Window.partitionBy("key").orderBy("pos", "end")
    before, so_far = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(c("officer").isNotNull(), F.struct("pos", "officer")), ignorenulls=True).over(so_far)
    events = came.unionByName(held).select(
        "*",
        seen.alias("seen"),
        F.last(F.when(c("end"), c("pos")), ignorenulls=True).over(before).alias("used"),
        (F.first("pos").over(so_far)["new"] == 0).alias("known"),
        F.lead("pos").over(along).isNull().alias("last"),
    )
    man = F.when(c("used").isNull() | (c("seen.pos") > c("used")), c("seen.officer.employee_id"))
    kind = F.when(c("row.status") == S.APPROVED, APPROVED).when(c("row.status") == S.REJECTED, "audit_reject").otherwise("audit_cancel")
    at = c("row.update_time")
    full = events.withColumns({x: c("row")[x] for x in came.schema["row"].dataType.names} | {"audit_man_id": man, "approve_time": at, "reject_time": at, "cancel_time": at})
    payload = F.coalesce(*[F.when(kind == k, F.to_json(F.struct(*KINDS[k]))) for k in (APPROVED, "audit_reject", "audit_cancel")])
    gone = c("end") | c("officer").isNull()
    stays = F.to_json(F.struct(c("key").alias("id"), c("officer.employee_id").alias("employee_id"), F.lit(now_ms).cast("long").alias("since"), gone.alias("deleted")))
    changed = c("last") & F.when(gone, c("known")).otherwise(c("pos.new") == 1)
    out = [F.when(c("end"), F.struct(kind.alias("kind"), payload.alias("payload"))), F.when(changed, F.struct(F.lit(OFFICER).alias("kind"), stays.alias("payload")))]
    return full.select(F.inline(F.array_compact(F.array(*out))))


def approvals(approved: DataFrame, changes: DataFrame, patience: str | None = None) -> DataFrame:
    """``kind, payload`` of audit_approve, from the layer of approved applications and
    the replies among fact changes."""
    left = _facts(approved, "approved")
    right = _rows(changes, "reply").withColumnRenamed("credit_facility_id", "_key").drop("type")
    both = _paired(left, right, "id", ("approve_time", "reply_time"), patience, ["id", "approve_time"])
    return with_payload(both.select(F.lit("audit_approve").alias("kind"), *S.FACTS["audit_approve"]))


def _step_rows(changes: DataFrame) -> DataFrame:
    """Credit rows with the fact that their step gives, and its time."""
    step = F.when(F.col("type") == "insert", STEPS["add"]).when(F.col("status") == S.CREDIT_OCCUPIED, STEPS["occupy"]).when(F.col("status") == S.CREDIT_PRODUCED, STEPS["produced"])
    rows = _rows(changes, "credit").withColumn("kind", step).where(F.col("kind").isNotNull())
    time = F.when(F.col("kind") == STEPS["add"], F.col("add_time")).when(F.col("kind") == STEPS["occupy"], F.col("occupy_time")).otherwise(F.col("produced_time"))
    return rows.withColumn("_time", time)


def credit_steps(approved: DataFrame, changes: DataFrame, patience: str | None = None) -> DataFrame:
    """``kind, payload`` of credit_add, credit_occupy and contract_produced, from the
    layer of audit_approve facts and the credit rows among fact changes."""
    left = _facts(approved, "audit_approve").select(F.col("id").alias("credit_facility_id"), "approve_time", "apply_amount", "reply_amount")
    right = _step_rows(changes).withColumnRenamed("credit_facility_id", "_key").drop("type", "status")
    both = _paired(left, right, "credit_facility_id", ("approve_time", "_time"), patience, ["kind", "id", "_time"])
    produced = F.col("kind") == STEPS["produced"]
    named = both.withColumn("credit_id", F.col("id")).withColumn("id", F.when(produced, F.col("contract_id")).otherwise(F.col("id")))
    columns = list(dict.fromkeys(c for k in STEPS.values() for c in S.FACTS[k]))
    return with_payload(named.select("kind", *columns))


def _side(rows: DataFrame, key: str, name: list[str], second: bool, done: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows as ``met`` takes them; ``columns`` as their struct, if they bring one."""
    return rows.select(
        F.col(key).alias("key"),
        F.lit(second).alias("second"),
        F.array(*name).alias("name"),
        F.lit(not done).alias("open"),
        (F.struct(*columns) if columns else F.lit(None)).alias("row"),
    )


def _sides(firsts: DataFrame, seconds: DataFrame) -> DataFrame:
    none = F.lit(None)
    a = firsts.withColumnRenamed("row", "first").withColumn("row", none.cast(seconds.schema["row"].dataType))
    b = seconds.withColumn("first", none.cast(firsts.schema["row"].dataType))
    return a.unionByName(b)


def met(sides: DataFrame) -> DataFrame:
    """Firsts (``second`` is false) and seconds of each key, in one shuffle: adds to each
    row ``found``, the first that stands first of its key, ``again`` (a first after
    another, or a second whose name came before) and ``alone`` (a first without any
    second). Seconds that are not ``open`` were paired in an earlier batch."""
    along = Window.partitionBy("key").orderBy("second", "name", "open")
    so_far, whole = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = F.lag(F.struct("second", "name")).over(along).eqNullSafe(F.struct("second", "name"))
    return sides.select(
        "*",
        F.first("first", ignorenulls=True).over(so_far).alias("found"),
        F.when(F.col("second"), same).otherwise(F.row_number().over(along) > 1).alias("again"),
        (~F.max("second").over(whole)).alias("alone"),
    ).where(F.col("open") & ~F.col("again"))


_REPLY = ("credit_facility_id", *REPLIED)


def _replies(rows: DataFrame) -> DataFrame:
    return _side(rows, "credit_facility_id", ["reply_time", "reply_id"], second=False, columns=_REPLY)


def _approved(rows: DataFrame) -> DataFrame:
    return _side(rows, "id", ["approve_time"], second=True, columns=tuple(KINDS[APPROVED]))


def approval_sides(approved: DataFrame, changes: DataFrame) -> DataFrame:
    """Replies and approved applications of a batch."""
    return _sides(_replies(_rows(changes, "reply")), _approved(_facts(approved, APPROVED)))


def approval_sides_before(early_replies: DataFrame, early_approvals: DataFrame, made: DataFrame) -> DataFrame:
    """Those that wait, and the replies and approvals of the facts ``made`` so far."""
    parsed = [x.select(F.inline(F.array(F.from_json("payload", ", ".join(f"{c} string" for c in columns))))) for x, columns in ((early_replies, _REPLY), (early_approvals, KINDS[APPROVED]))]
    facts = _facts(made, "audit_approve").withColumn("credit_facility_id", F.col("id"))
    seconds = _approved(parsed[1])
    done = _side(facts, "id", ["approve_time"], second=True, done=True).withColumn("row", F.lit(None).cast(seconds.schema["row"].dataType))
    return _sides(_replies(parsed[0]).unionByName(_replies(facts)), seconds.unionByName(done))


def approvals_met(sides: DataFrame) -> DataFrame:
    """``kind, payload`` of audit_approve, and of what waits, as JSON of its columns."""
    c = F.col
    rows = met(sides).withColumn("kind", F.when(c("second") & c("found").isNotNull(), "audit_approve").when(c("second"), EARLY_APPROVAL).when(c("alone"), EARLY_REPLY))
    full = rows.select("kind", "first", "row", "found", *[c("row")[x].alias(x) for x in KINDS[APPROVED]], *[c("found")[x].alias(x) for x in REPLIED])
    return _texts(full, {"audit_approve": F.struct(*S.FACTS["audit_approve"]), EARLY_APPROVAL: c("row"), EARLY_REPLY: c("first")})


_STEP = ("kind", "id", "credit_facility_id", "contract_id", "credit_amount", "at")


def _steps(rows: DataFrame) -> DataFrame:
    return _side(rows, "credit_facility_id", ["kind", "id", "at"], second=True, columns=_STEP)


def _amounts(approved: DataFrame) -> DataFrame:
    return _side(_facts(approved, "audit_approve"), "id", ["approve_time"], second=False, columns=("apply_amount", "reply_amount"))


def _step_time(kind: str) -> str:
    return next(c for c in S.FACTS[kind] if c.endswith("_time"))


def credit_sides(approved: DataFrame, changes: DataFrame) -> DataFrame:
    """Approvals and steps of credits of a batch."""
    return _sides(_amounts(approved), _steps(_step_rows(changes).withColumnsRenamed({"_time": "at"})))


def credit_sides_before(early: DataFrame, approved: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
    """Steps that wait, all approvals, and the steps of the facts ``made`` so far."""
    seconds = _steps(early.select(F.inline(F.array(F.from_json("payload", ", ".join(f"{c} string" for c in _STEP))))))
    for kind, layer in made.items():
        facts = _facts(layer, kind).withColumns({"kind": F.lit(kind), "id": F.col("credit_id" if "credit_id" in KINDS[kind] else "id"), "at": F.col(_step_time(kind))})
        done = _side(facts, "credit_facility_id", ["kind", "id", "at"], second=True, done=True)
        seconds = seconds.unionByName(done.withColumn("row", F.lit(None).cast(seconds.schema["row"].dataType)))
    return _sides(_amounts(approved), seconds)


def credits_met(sides: DataFrame) -> DataFrame:
    """``kind, payload`` of the facts of credits, and of the steps that wait."""
    c = F.col
    rows = met(sides).where("second").select("found", "row", *[c("row")[x].alias(x) for x in _STEP], c("found")["apply_amount"].alias("apply_amount"), c("found")["reply_amount"].alias("reply_amount"))
    texts = {}
    for kind in STEPS.values():
        own = {"credit_id": c("id"), "id": c("contract_id")} if kind == STEPS["produced"] else {}
        texts[kind] = F.struct(*[(c("at") if x == _step_time(kind) else own.get(x, c(x))).alias(x) for x in S.FACTS[kind]])
    waits = rows.withColumn("kind", F.when(c("found").isNull(), EARLY_CREDIT).otherwise(c("kind")))
    return _texts(waits, texts | {EARLY_CREDIT: c("row")})


def _texts(rows: DataFrame, structs: dict[str, Column]) -> DataFrame:
    """``kind, payload``: the struct of each row's kind as JSON; other rows are left out."""
    texts = [F.when(F.col("kind") == k, F.to_json(s)) for k, s in structs.items()]
    return rows.where(F.col("kind").isNotNull()).select("kind", F.coalesce(*texts).alias("payload"))
