"""Change logs made from the test tables, in the sources' envelope format."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.scratch import NO_LEFTOVERS, with_conf
from leaselake.sources.lease_views import lease_view

_NO_MAP = "map<string,string>"
_KEYS = {"credit_facility": "id", "credit_facility_status": "credit_facility_id", "reply": "id", "credit": "id", "contract": "id"}


def _text(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.col(column).cast("string")


def envelope(df: DataFrame, table: str, kind: str, at: Column, step: int, columns: list[str], data: Column | None = None) -> DataFrame:
    """One change per row: ``columns`` as the row's data, ``at`` as its second,
    ``step`` and the row's id as its place within that second."""
    cells = data if data is not None else F.create_map(*[x for c in columns for x in (F.lit(c), _text(df, c))])
    return df.select(
        F.lit("lease").alias("database"),
        F.lit(table).alias("table"),
        F.lit(kind).alias("type"),
        F.unix_timestamp(at.cast("timestamp")).alias("ts"),
        F.lit(step).cast("long").alias("xid"),
        F.col(columns[0]).cast("long").alias("xoffset"),
        cells.alias("data"),
        F.lit(None).cast(_NO_MAP).alias("old"),
    )


def lease_log(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = tuple(_KEYS)) -> DataFrame:
    """Every change of applications, status rows, replies, credits and contracts, or of
    those of them that ``tables`` names. Numbers and ids become strings in the maps, as
    the log's parser makes them."""
    # dealt by their keys while they are narrow: a table in one row group would be one task's texts
    view = {n: lease_view(spark, sf_dir, n).repartition(key) for n, key in _KEYS.items()}
    apps, credit, contract = view["credit_facility"], view["credit"], view["contract"]
    times = apps.select(F.col("id").alias("_app"), "update_time")
    status = view["credit_facility_status"].join(times, F.col("credit_facility_id") == F.col("_app"))
    c = F.col
    credit_columns = ["id", "credit_facility_id", "status", "contract_id", "credit_amount", "create_time", "credit_occupy_time", "contract_produce_time"]

    def step(rows: DataFrame, status_code: int) -> DataFrame:
        return rows.withColumn("status", F.lit(status_code))

    parts = [
        (status, "credit_facility_status", "insert", c("update_time"), 0, ["credit_facility_id", "status", "employee_id"]),
        (apps, "credit_facility", "update", c("update_time"), 1, apps.columns),
        (view["reply"], "reply", "insert", c("create_time"), 2, view["reply"].columns),
        (step(credit, 1), "credit", "insert", c("create_time"), 3, credit_columns),
        (step(credit.where("credit_occupy_time IS NOT NULL"), 2), "credit", "update", c("credit_occupy_time"), 4, credit_columns),
        (step(credit.where("contract_produce_time IS NOT NULL"), 3), "credit", "update", c("contract_produce_time"), 5, credit_columns),
        (step(contract.where("signed_time IS NOT NULL"), 2), "contract", "update", c("signed_time"), 6, contract.columns),
        (step(contract.where("execution_time IS NOT NULL"), 3), "contract", "update", c("execution_time"), 7, contract.columns),
    ]
    return reduce(DataFrame.unionByName, [envelope(*part) for part in parts if part[1] in tables])


def dimension_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of employees (from suppliers) and partners (from customers), with
    bootstrap markers, a column that is not configured and a table that is not."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    epoch = F.lit("2024-01-01 00:00:00")

    def employee(rows: DataFrame, kind: str, step: int, name: Column) -> DataFrame:
        data = F.create_map(F.lit("id"), F.col("s_suppkey").cast("string"), F.lit("name"), name, F.lit("department_id"), (F.lit(1000) + F.col("s_nationkey")).cast("string"), F.lit("balance"), F.col("s_acctbal").cast("string"))
        return envelope(rows, "employee", kind, epoch, step, ["s_suppkey"], data)

    def renumbered(rows: DataFrame, kind: str, step: int) -> DataFrame:
        """Deletes of rows whose id was changed before; ``old`` tells which they were."""
        new = F.create_map(F.lit("id"), (F.lit(5_000_000) + F.col("s_suppkey")).cast("string"), F.lit("name"), F.col("s_name"), F.lit("department_id"), (F.lit(1000) + F.col("s_nationkey")).cast("string"))
        return envelope(rows, "employee", kind, epoch, step, ["s_suppkey"], new).withColumn("old", F.create_map(F.lit("id"), F.col("xoffset").cast("string")))

    def partner(suffix: str = "") -> Column:
        return F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.concat("c_name", F.lit(suffix)), F.lit("segment"), F.col("c_mktsegment"))

    parts = [
        employee(suppliers.where("s_suppkey % 11 = 0"), "bootstrap-start", 0, F.col("s_name")),
        employee(suppliers, "bootstrap-insert", 1, F.col("s_name")),
        employee(suppliers.where("s_suppkey % 5 = 0"), "update", 2, F.concat("s_name", F.lit(" moved"))),
        renumbered(suppliers.where("s_suppkey % 7 = 0"), "delete", 3),
        employee(suppliers.where("s_suppkey % 21 = 0"), "insert", 4, F.lit(None).cast("string")),
        envelope(customers, "business_partner", "insert", epoch, 1, ["c_custkey"], partner()),
        envelope(customers.where("c_custkey % 4 = 0"), "business_partner", "update", epoch, 2, ["c_custkey"], partner(" again")),
        envelope(customers.where("c_custkey % 3 = 0"), "partner_note", "insert", epoch, 1, ["c_custkey"], partner()),
    ]
    return reduce(DataFrame.unionByName, parts)


def as_json(log: DataFrame) -> DataFrame:
    """The log as lines of JSON in column ``value``."""
    return log.select(F.to_json(F.struct(*log.columns)).alias("value"))


def write_log(values: DataFrame, path: str, mode: str = "error") -> None:
    """Lines of a log as compressed text: names repeat in each of them, so the fastest
    level leaves little."""
    with with_conf(values.sparkSession, NO_LEFTOVERS):
        values.write.mode(mode).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def config_lines(run: int) -> list[str]:
    """Configuration changes before the first and the second part of the dimension
    log: two tables are there and one is made; then one of them gets another target
    and the one that was made is taken away."""

    def entry(source: str, sink: str, columns: str) -> dict:
        return {"source_table": source, "sink_table": sink, "sink_family": "info", "sink_columns": columns, "sink_row_key": "id"}

    employee, partner = entry("employee", "dim_employee", "id,name"), entry("business_partner", "dim_business_partner", "id")
    note, moved = entry("partner_note", "dim_partner_note", "id"), entry("business_partner", "dim_partner", "id,name")
    changes = {
        1: [("r", None, employee), ("r", None, partner), ("c", None, note)],
        2: [("u", employee, employee), ("u", partner, moved), ("d", note, None)],
    }[run]
    return [json.dumps({"op": op, "before": before, "after": after, "ts_ms": 100 * run + n}) for n, (op, before, after) in enumerate(changes)]
