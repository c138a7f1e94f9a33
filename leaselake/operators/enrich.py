"""Enrichment of summaries with dimension names: left joins, rows always kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.operators.dimensions import flattened

_BOUNDS = ["stt", "edt", "cur_date"]


def enrich(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Adds ``columns`` (new name: dimension column) by ``key``; null where the
    dimension has no row. No broadcast is forced: the optimizer sends the
    dimension to the tasks only if its size allows it."""
    side = dim.select(F.col(dim_key).alias("_dim_key"), *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.join(side, rows[key] == side["_dim_key"], "left").drop("_dim_key")


def with_hierarchies(summary: DataFrame, industries: DataFrame, employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Industry, salesman and department names of a summary by industry, direction
    and salesman. The trees are flattened once, so seven lookups are three joins,
    made after the sums have shrunk the rows."""
    industry = flattened(industries, "industry_name", "superior_industry_id", "industry")
    department = flattened(departments, "department_name", "superior_department_id", "department")
    out = enrich(summary, industry, "industry3_id", "industry3_id", {c: c for c in industry.columns if c != "industry3_id"})
    out = enrich(out, employees, "salesman_id", "id", {"salesman_name": "name", "department3_id": "department_id"})
    out = enrich(out, department, "department3_id", "department3_id", {c: c for c in department.columns if c != "department3_id"})
    names = [f"industry{n}_{x}" for n in (3, 2, 1) for x in ("id", "name")] + ["salesman_id", "salesman_name"]
    names += [f"department{n}_{x}" for n in (3, 2, 1) for x in ("id", "name")]
    measures = [c for c in ("apply_count", "apply_amount", "reply_amount") if c in summary.columns]
    return out.select(*_BOUNDS, "lease_organization", *names, *measures)


def with_officer_name(summary: DataFrame, employees: DataFrame) -> DataFrame:
    out = enrich(summary, employees, "audit_man_id", "id", {"audit_man_name": "name"})
    measures = [c for c in ("apply_count", "apply_amount", "reply_amount") if c in summary.columns]
    return out.select(*_BOUNDS, "audit_man_id", "audit_man_name", *measures)
