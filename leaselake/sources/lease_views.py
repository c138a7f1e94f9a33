"""Lease tables derived from the star-schema test tables.

The text runs on Spark SQL and DuckDB alike: ``with_views`` puts it in front of a
query for the oracle, ``lease_view`` reads one of the tables as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "supplier", "orders")

VIEWS = {
    "dim_department": """
SELECT 1 + r_regionkey AS id, 1 AS department_level, r_name AS department_name, CAST(NULL AS INT) AS superior_department_id FROM region
UNION ALL SELECT 100 + n_nationkey, 2, n_name, 1 + n_regionkey FROM nation
UNION ALL SELECT 1000 + n_nationkey, 3, concat(n_name, ' office'), 100 + n_nationkey FROM nation""",
    "dim_industry": """
SELECT 1 + r_regionkey AS id, 1 AS industry_level, concat('sector ', r_name) AS industry_name, CAST(NULL AS INT) AS superior_industry_id FROM region
UNION ALL SELECT 100 + n_nationkey, 2, concat('group ', n_name), 1 + n_regionkey FROM nation
UNION ALL SELECT 1000 + n_nationkey, 3, concat('class ', n_name), 100 + n_nationkey FROM nation""",
    "dim_employee": "SELECT s_suppkey AS id, s_name AS name, 1000 + s_nationkey AS department_id FROM supplier",
    "credit_facility": """
SELECT o_orderkey AS id, o_orderpriority AS lease_organization, o_custkey AS business_partner_id, 1000 + o_orderkey % 30 AS industry_id,
  o_orderkey % (SELECT count(*) FROM supplier) AS salesman_id, CAST(o_totalprice AS DECIMAL(16,2)) AS credit_amount,
  CASE o_orderkey % 10 WHEN 0 THEN 20 WHEN 1 THEN 21 ELSE 16 END AS status,
  o_orderdate + (o_orderkey % 7) * 2 * INTERVAL '1' SECOND AS update_time
FROM orders""",
    "credit_facility_status": """
SELECT o_orderkey AS credit_facility_id, 5 AS status, (o_orderkey * 7) % (SELECT count(*) FROM supplier) AS employee_id
FROM orders WHERE o_orderkey % 3 <> 0""",
    "reply": """
SELECT 1000000 + id AS id, id AS credit_facility_id, CAST(credit_amount - 10 AS DECIMAL(16,2)) AS credit_amount,
  update_time + 3 * INTERVAL '1' SECOND AS create_time, CAST(0.05 AS DECIMAL(18,6)) AS irr, 12 + id % 24 AS period
FROM credit_facility WHERE status = 16""",
    "credit": """
SELECT 2000000 + id AS id, id AS credit_facility_id, CAST(credit_amount - 20 AS DECIMAL(16,2)) AS credit_amount,
  CASE WHEN id % 10 >= 6 THEN 3 WHEN id % 10 >= 4 THEN 2 ELSE 1 END AS status,
  update_time + 5 * INTERVAL '1' SECOND AS create_time,
  CASE WHEN id % 10 >= 4 THEN update_time + 15 * INTERVAL '1' SECOND END AS credit_occupy_time,
  CASE WHEN id % 10 >= 6 THEN update_time + 25 * INTERVAL '1' SECOND END AS contract_produce_time,
  CASE WHEN id % 10 >= 6 THEN 3000000 + id END AS contract_id
FROM credit_facility WHERE status = 16""",
    "contract": """
SELECT contract_id AS id, id AS credit_id,
  CASE WHEN credit_facility_id % 10 >= 8 THEN 3 WHEN credit_facility_id % 10 = 7 THEN 2 ELSE 1 END AS status,
  CASE WHEN credit_facility_id % 10 >= 7 THEN contract_produce_time + 5 * INTERVAL '1' SECOND END AS signed_time,
  CASE WHEN credit_facility_id % 10 >= 8 THEN contract_produce_time + 15 * INTERVAL '1' SECOND END AS execution_time
FROM credit WHERE contract_id IS NOT NULL""",
}


def with_views(query: str, more: dict[str, str] | None = None, base: dict[str, str] | None = None) -> str:
    """``query`` after the lease tables it names (and those that they name), as
    common table expressions; ``base`` stands in for tables that they read, ``more``
    reads them."""
    views = (base or {}) | VIEWS | (more or {})
    needed: set[str] = set()
    texts = [query]
    while texts:
        text = texts.pop()
        for name in views:
            if name not in needed and _names(text, name):
                needed.add(name)
                texts.append(views[name])
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in views if n in needed) + "\n" + query


def _names(text: str, name: str) -> bool:
    import re

    return re.search(rf"(?i)\b(?:from|join)\s+{name}\b", text) is not None


def lease_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One lease table over the Parquet tables of ``sf_dir``. The tables are named by
    their files, so nothing is registered in the session."""
    files = {b: f"SELECT * FROM parquet.`{sf_dir}/{b}.parquet`" for b in BASE}
    return spark.sql(with_views(f"SELECT * FROM {name}", base=files))
