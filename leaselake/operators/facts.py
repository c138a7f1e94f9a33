"""Facts in their relational form: joins of whole tables, any arrival order.

Inputs are typed rows (see ``projections.ROWS``); ``pos`` is a sortable place in
the log. The rules are those of the lifecycle processors' complete mode, so the
stream and the batch give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaselake import schemas as S

_ENDS = (S.APPROVED, S.REJECTED, S.CANCELLED)


def with_officer(applications: DataFrame, statuses: DataFrame) -> DataFrame:
    """Adds ``audit_man_id``: the officer of the newest status row (5, 6 or 20)
    before an application's terminal event and after the one before it, so each
    officer row serves once. One shuffle on the application's id."""
    seen = statuses.where(F.col("status").cast("string").isin(*S.OFFICER_STATUSES)).select(
        F.col("credit_facility_id").alias("id"), "pos", F.col("employee_id").cast("string").alias("_officer"), F.lit(0).alias("_end"), F.lit(None).cast(_struct(applications)).alias("_row")
    )
    ends = applications.where(F.col("status").cast("string").isin(*_ENDS)).select(
        "id", "pos", F.lit(None).cast("string").alias("_officer"), F.lit(1).alias("_end"), F.struct(*applications.columns).alias("_row")
    )
    along = Window.partitionBy("id").orderBy("pos", "_end")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.coalesce(F.sum("_end").over(before), F.lit(0))
    so_far = Window.partitionBy("id", "_turn").orderBy("pos", "_end").rowsBetween(Window.unboundedPreceding, 0)
    officer = F.last("_officer", ignorenulls=True).over(so_far)
    events = seen.unionByName(ends).withColumn("_turn", turn).withColumn("audit_man_id", officer)
    return events.where(F.col("_end") == 1).select("_row.*", "audit_man_id")


def _struct(df: DataFrame) -> str:
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType.simpleString()


def audit_approve(officered: DataFrame, replies: DataFrame) -> DataFrame:
    approved = officered.where(F.col("status").cast("string") == S.APPROVED).withColumnRenamed("update_time", "approve_time")
    return approved.join(replies, approved["id"] == replies["credit_facility_id"]).select(*S.FACTS["audit_approve"])


def audit_cancel(officered: DataFrame) -> DataFrame:
    return _ended(officered, S.CANCELLED, "audit_cancel", "cancel_time")


def audit_reject(officered: DataFrame) -> DataFrame:
    return _ended(officered, S.REJECTED, "audit_reject", "reject_time")


def _ended(officered: DataFrame, status: str, fact: str, time: str) -> DataFrame:
    return officered.where(F.col("status").cast("string") == status).withColumnRenamed("update_time", time).select(*S.FACTS[fact])


def credit_fact(credits: DataFrame, approvals: DataFrame, fact: str) -> DataFrame:
    """``credit_add``, ``credit_occupy`` or ``contract_produced``: credit rows whose
    step has a time, with the amounts of the approved application."""
    amounts = approvals.select(F.col("id").alias("_app"), "apply_amount", "reply_amount")
    time = next(c for c in S.FACTS[fact] if c.endswith("_time"))
    happened = credits.where(F.col(time).isNotNull()).join(amounts, F.col("credit_facility_id") == F.col("_app"))
    if fact == "contract_produced":
        happened = happened.withColumnRenamed("id", "credit_id").withColumn("id", F.col("contract_id"))
    return happened.select(*S.FACTS[fact])


def lease_fact(contracts: DataFrame, produced: DataFrame, fact: str) -> DataFrame:
    """``lease_sign`` or ``lease_execution``: contracts whose step has a time, with
    what the produced contract's fact knows."""
    time = next(c for c in S.FACTS[fact] if c.endswith("_time"))
    known = produced.select(F.col("credit_id").alias("_credit"), "credit_facility_id", "apply_amount", "reply_amount", "credit_amount")
    steps = contracts.where(F.col(time).isNotNull()).select("id", "credit_id", time)
    return steps.join(known, F.col("credit_id") == F.col("_credit")).select(*S.FACTS[fact])
