"""Typed rows of the business tables from change envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake import schemas as S
from leaselake.functions import event_time

#: (column, source field, kind) of each fact table's rows; kind t is a time.
ROWS = {
    "credit_facility": [
        ("id", "id", "string"),
        ("lease_organization", "lease_organization", "string"),
        ("business_partner_id", "business_partner_id", "string"),
        ("industry_id", "industry_id", "string"),
        ("salesman_id", "salesman_id", "string"),
        ("apply_amount", "credit_amount", S.MONEY),
        ("status", "status", "string"),
        ("update_time", "update_time", "t"),
    ],
    "credit_facility_status": [("credit_facility_id", "credit_facility_id", "string"), ("status", "status", "string"), ("employee_id", "employee_id", "string")],
    "reply": [
        ("reply_id", "id", "string"),
        ("credit_facility_id", "credit_facility_id", "string"),
        ("reply_amount", "credit_amount", S.MONEY),
        ("irr", "irr", S.RATE),
        ("period", "period", "long"),
        ("reply_time", "create_time", "t"),
    ],
    "credit": [
        ("id", "id", "string"),
        ("credit_facility_id", "credit_facility_id", "string"),
        ("status", "status", "string"),
        ("contract_id", "contract_id", "string"),
        ("credit_amount", "credit_amount", S.MONEY),
        ("add_time", "create_time", "t"),
        ("occupy_time", "credit_occupy_time", "t"),
        ("produced_time", "contract_produce_time", "t"),
    ],
    "contract": [("id", "id", "string"), ("credit_id", "credit_id", "string"), ("status", "status", "string"), ("signed_time", "signed_time", "t"), ("execution_time", "execution_time", "t")],
}


def typed_rows(changes: DataFrame, table: str) -> DataFrame:
    """Rows of one table with names of the facts, the change's ``type`` and its
    place in the log."""
    cells = [_cell(field, kind).alias(name) for name, field, kind in ROWS[table]]
    return changes.where(F.col("table") == table).select("type", *S.POSITION, *cells)


def _cell(field: str, kind: str) -> Column:
    value = F.col("data")[field]
    return event_time(value) if kind == "t" else value.cast(kind)


def row_image(changes: DataFrame) -> DataFrame:
    """Adds ``row``, the row a change is about: for a delete the old values where
    there are any, else the given ones; for all others the new row."""
    old = F.coalesce("old", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter("data", lambda k, _: ~F.map_contains_key(old, k)), old)
    return changes.withColumn("row", F.when(F.col("type") == "delete", F.coalesce(merged, F.col("old"), F.col("data"))).otherwise(F.col("data")))


def pruned(rows: DataFrame, columns: str = "sink_columns") -> DataFrame:
    """``row`` cut down to the keys that the configuration lists."""
    wanted = F.transform(F.split(F.col(columns), ","), lambda x: F.trim(x))
    return rows.withColumn("row", F.map_filter("row", lambda k, _: F.array_contains(wanted, k)))
