"""Schemas, status codes and column contracts of the lease warehouse."""

from __future__ import annotations

from pyspark.sql import types as T

# Change envelope: one JSON object per changed row of a business table. Values of
# the row and of its changed columns differ by table, so they are string maps.
ENVELOPE = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("xid", T.LongType()),
        T.StructField("xoffset", T.LongType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("old", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Order of changes within the log.
POSITION = ("ts", "xid", "xoffset")

# Configuration of dimension tables: which source table feeds which target.
TABLE_PROCESS = T.StructType([T.StructField(n, T.StringType()) for n in ("source_table", "sink_table", "sink_family", "sink_columns", "sink_row_key")])
CONFIG_ENVELOPE = T.StructType(
    [
        T.StructField("before", TABLE_PROCESS),
        T.StructField("after", TABLE_PROCESS),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)

# The four dimension tables of the warehouse.
DIMENSION_CONFIG = [
    ("business_partner", "dim_business_partner", "info", "id,create_time,update_time,name", "id"),
    ("department", "dim_department", "info", "id,create_time,update_time,department_level,department_name,superior_department_id", "id"),
    ("employee", "dim_employee", "info", "id,create_time,update_time,name,type,department_id", "id"),
    ("industry", "dim_industry", "info", "id,create_time,update_time,industry_level,industry_name,superior_industry_id", "id"),
]

# Types of changes that are no row, and status codes.
BOOTSTRAP_MARKERS = ("bootstrap-start", "bootstrap-complete")
APPROVED, REJECTED, CANCELLED = "16", "20", "21"
OFFICER_STATUSES = ("5", "6", "20")
CREDIT_OCCUPIED, CREDIT_PRODUCED = "2", "3"
CONTRACT_SIGNED, CONTRACT_STARTED = "2", "3"

#: Key of a fact table's rows that must be present, by source table.
FACT_KEYS = {
    "credit_facility": "id",
    "credit_facility_status": "credit_facility_id",
    "reply": "credit_facility_id",
    "credit": "credit_facility_id",
    "contract": "credit_id",
}

MONEY = "decimal(16,2)"
RATE = "decimal(18,6)"
#: Zone of the sources' time strings; jobs work in a session of this zone.
SOURCE_ZONE = "+08:00"
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"

_IDENTITY = ["id", "lease_organization", "business_partner_id", "industry_id", "reply_id", "salesman_id", "audit_man_id"]
_AMOUNTS = ["apply_amount", "reply_amount", "credit_amount"]

#: Columns of the fact tables, in order.
FACTS = {
    "audit_approve": [*_IDENTITY, "apply_amount", "reply_amount", "approve_time", "reply_time", "irr", "period"],
    "audit_cancel": [*[c for c in _IDENTITY if c != "reply_id"], "apply_amount", "cancel_time"],
    "audit_reject": [*[c for c in _IDENTITY if c != "reply_id"], "apply_amount", "reject_time"],
    "credit_add": ["id", "credit_facility_id", "add_time", *_AMOUNTS],
    "credit_occupy": ["id", "credit_facility_id", "occupy_time", *_AMOUNTS],
    "contract_produced": ["id", "credit_id", "credit_facility_id", "produced_time", *_AMOUNTS],
    "lease_sign": ["id", "credit_id", "credit_facility_id", "signed_time", *_AMOUNTS],
    "lease_execution": ["id", "credit_id", "credit_facility_id", "execution_time", *_AMOUNTS],
}
