"""Tumbling summaries: one operator and the eleven jobs that are rows of a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake import schemas as S
from leaselake.functions import day_of, second_of

WINDOW = "10 seconds"
_CREDIT = ("apply_amount", "reply_amount", "credit_amount")
_AUDIT = ("apply_amount", "reply_amount")
_GROUP = ("lease_organization", "industry3_id", "salesman_id")


@dataclass(frozen=True)
class Summary:
    """A summary job: its fact, event time, keys and sums; ``required`` columns
    must not be null; ``delay`` is how late a row may come in the stream."""

    fact: str
    time: str
    keys: tuple[str, ...] = ()
    sums: tuple[str, ...] = _CREDIT
    required: tuple[str, ...] = ()
    delay: str = "5 seconds"


SUMMARIES = {
    "ind_org_salesman_approval": Summary("audit_approve", "approve_time", _GROUP, _AUDIT),
    "ind_org_salesman_cancel": Summary("audit_cancel", "cancel_time", _GROUP, _AUDIT[:1], delay="10 seconds"),
    "ind_org_salesman_reject": Summary("audit_reject", "reject_time", _GROUP, _AUDIT[:1]),
    "audit_man_approval": Summary("audit_approve", "approve_time", ("audit_man_id",), _AUDIT, ("audit_man_id",)),
    "audit_man_cancel": Summary("audit_cancel", "cancel_time", ("audit_man_id",), _AUDIT[:1], ("audit_man_id",)),
    "audit_man_reject": Summary("audit_reject", "reject_time", ("audit_man_id",), _AUDIT[:1], ("audit_man_id",)),
    "credit_add": Summary("credit_add", "add_time"),
    "credit_occupy": Summary("credit_occupy", "occupy_time"),
    "lease_contract_produce": Summary("contract_produced", "produced_time"),
    "lease_sign": Summary("lease_sign", "signed_time"),
    "lease_execution": Summary("lease_execution", "execution_time"),
}


def prepared(facts: DataFrame, spec: Summary) -> DataFrame:
    """The columns a summary needs; rows without a required one are dropped
    before anything is grouped. An application's industry is of level 3."""
    if "industry3_id" in spec.keys:
        facts = facts.withColumnRenamed("industry_id", "industry3_id")
    for c in spec.required:
        facts = facts.where(F.col(c).isNotNull())
    return facts.select(spec.time, *spec.keys, *spec.sums)


def tumbling_summary(rows: DataFrame, time: str, keys: tuple[str, ...], sums: tuple[str, ...], size: str = WINDOW) -> DataFrame:
    """Counts and sums per window and key, for batch and stream alike: ``stt`` and
    ``edt`` (window bounds), ``cur_date`` (day of the start), keys, ``apply_count``
    and the sums. Sums skip nulls; null keys form a group. Partial aggregation
    keeps windows without a key off a single task."""
    total = [F.sum(c).cast(S.MONEY).alias(c) for c in sums]
    grouped = rows.groupBy(F.window(time, size).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("apply_count"), *total)
    return grouped.select(second_of(F.col("_w.start")).alias("stt"), second_of(F.col("_w.end")).alias("edt"), day_of(F.col("_w.start")).alias("cur_date"), *keys, "apply_count", *sums)


def once(facts: DataFrame, spec: Summary) -> DataFrame:
    """A stream of facts with its watermark, each fact once."""
    known = [F.col(c).isNotNull() for c in spec.required]  # others do not count, and do not move the watermark
    return reduce(DataFrame.where, known, facts).withWatermark(spec.time, spec.delay).dropDuplicatesWithinWatermark(["id", spec.time])


def summarize(facts: DataFrame, name: str, streaming: bool = False) -> DataFrame:
    """One of ``SUMMARIES`` over its fact table. A stream gets its watermark, and a fact
    that is delivered again (same id and time) counts once while a window that it
    belongs to may be open."""
    spec = SUMMARIES[name]
    rows = prepared(once(facts, spec) if streaming else facts, spec)
    return tumbling_summary(rows, spec.time, spec.keys, spec.sums)


def rolled_up_days(facts: DataFrame, name: str, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The application layer by day, from a stream of facts: the summary's closed
    windows, enriched, are summed again by the day in which they lie, so a day comes
    out once, after its last window is closed. ``enrich`` joins tables that stand still."""
    spec = SUMMARIES[name]
    rows = prepared(once(facts, spec), spec)
    total = [F.sum(c).cast(S.MONEY).alias(c) for c in spec.sums]
    windows = rows.groupBy(F.window(spec.time, WINDOW).alias("_w"), *spec.keys).agg(F.count(F.lit(1)).alias("apply_count"), *total)
    named = enrich(windows.select(F.window_time("_w").alias("at"), *spec.keys, "apply_count", *spec.sums))
    levels = [("industry", "industry1_name"), ("department", "department1_name"), ("direction", "lease_organization")]
    cells = named.withColumn("of", F.explode(F.array([F.struct(F.lit(level).alias("level"), F.col(c).alias("name")) for level, c in levels])))
    midnight = f"{-int(S.SOURCE_ZONE[:3]) % 24} hours"  # of the sources' zone, after that of UTC
    day = F.window("at", "1 day", "1 day", midnight).alias("_d")
    sums = [F.sum(c).cast("decimal(26,2)").alias(c) for c in spec.sums]
    grouped = cells.groupBy(day, F.col("of.level").alias("level"), F.col("of.name").alias("name")).agg(F.sum("apply_count").alias("apply_count"), *sums)
    return grouped.select(day_of(F.col("_d.start")).alias("cur_date"), "level", "name", "apply_count", *spec.sums)


def rolled_up(summary: DataFrame) -> DataFrame:
    """Application layer: audited sums by top industry, by top department and by
    business direction, in one pass by grouping sets."""
    dims = ["industry1_name", "department1_name", "lease_organization"]
    sets = [[F.col(d)] for d in dims]
    level = F.when(F.grouping(dims[0]) == 0, "industry").when(F.grouping(dims[1]) == 0, "department").otherwise("direction")
    return (
        summary.groupingSets(sets, *[F.col(d) for d in dims])
        .agg(level.alias("level"), F.sum("apply_count").alias("apply_count"), F.sum("apply_amount").cast("decimal(26,2)").alias("apply_amount"), F.sum("reply_amount").cast("decimal(26,2)").alias("reply_amount"))
        .select("level", F.coalesce(*dims).alias("name"), "apply_count", "apply_amount", "reply_amount")
    )
