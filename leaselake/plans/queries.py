"""Queries over the lease tables, one for each operator, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake import schemas as S
from leaselake.functions import camel_case, day_of, json_lines, renamed, second_of, snake_case
from leaselake.operators import dimensions, facts
from leaselake.operators.enrich import with_hierarchies, with_officer_name
from leaselake.operators.windows import SUMMARIES, rolled_up, summarize, tumbling_summary
from leaselake.plans.change_log import as_json, config_lines, dimension_log, lease_log, write_log
from leaselake.scratch import drop_path, file_system, new_path
from leaselake.sources.changelog import fact_changes, parse_changes, read_values, split_contracts
from leaselake.sources.lease_views import BASE, lease_view, with_views
from leaselake.streaming import jobs
from leaselake.streaming.sinks import exists, read_layer
from leaselake.streaming.tables import day_table, ddl, dimension_table, drop_old_days

Query = Callable[[SparkSession, str], DataFrame]


# Facts --------------------------------------------------------------------------


def fact_table(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    """One fact table in relational form over the lease tables."""
    view = partial(lease_view, spark, sf_dir)
    if fact.startswith("lease_"):
        return facts.lease_fact(view("contract"), fact_table(spark, sf_dir, "contract_produced"), fact)
    applications = view("credit_facility").withColumnRenamed("credit_amount", "apply_amount").withColumn("pos", F.lit(1))
    officered = facts.with_officer(applications, view("credit_facility_status").withColumn("pos", F.lit(0)))
    if fact in ("audit_cancel", "audit_reject"):
        return getattr(facts, fact)(officered)
    replies = view("reply").withColumnsRenamed({"id": "reply_id", "credit_amount": "reply_amount", "create_time": "reply_time"})
    approvals = facts.audit_approve(officered, replies)
    if fact == "audit_approve":
        return approvals
    credits = view("credit").withColumnsRenamed({"create_time": "add_time", "credit_occupy_time": "occupy_time", "contract_produce_time": "produced_time"})
    return facts.credit_fact(credits, approvals, fact)


def _times_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: second_of(F.col(c)) for c in df.columns if c.endswith("_time")})


def fact_query(fact: str) -> Query:
    return lambda spark, sf_dir: _times_as_text(fact_table(spark, sf_dir, fact))


def fact_officer_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications that ended, with the officer of the newest status row before the
    end. Each application has rows of several officers, two before its end, one of a
    status that does not count, and one after it; some have only the last."""
    ended = lease_view(spark, sf_dir, "credit_facility").withColumn("pos", F.col("update_time"))
    rows = [F.struct(F.lit(code).alias("status"), F.lit(second).alias("second"), (F.col("id") * 10 + n).alias("employee_id")) for n, (code, second) in enumerate(OFFICER_ROWS)]
    seen = ended.select(F.col("id").alias("credit_facility_id"), "pos", F.explode(F.array(*rows)).alias("s"))
    late = (F.col("credit_facility_id") % 4 == 0) & (F.col("s.second") < 0)
    statuses = seen.where(~late).select("credit_facility_id", "s.status", "s.employee_id", (F.col("pos") + F.expr("make_dt_interval(0, 0, 0, s.second)")).alias("pos"))
    return facts.with_officer(ended, statuses).select("id", "status", "audit_man_id")


#: (status, seconds after the application's end) of its status rows.
OFFICER_ROWS = ((5, -7200), (6, -3600), (1, -1800), (5, 3600))
_OFFICER_VIEWS = {
    "officer_rows": f"SELECT * FROM (VALUES {', '.join(f'({n}, {code}, {second})' for n, (code, second) in enumerate(OFFICER_ROWS))}) r(n, code, second)",
    "seen": """
SELECT f.id, f.update_time + r.second * INTERVAL '1' SECOND AS at, r.code, f.id * 10 + r.n AS officer
FROM credit_facility f JOIN officer_rows r ON NOT (f.id % 4 = 0 AND r.second < 0)""",
}
_OFFICER_SQL = """
SELECT f.id, f.status, CAST(max_by(s.officer, s.at) AS VARCHAR) AS audit_man_id
FROM credit_facility f LEFT JOIN seen s ON s.id = f.id AND s.code IN (5, 6, 20) AND s.at < f.update_time
WHERE f.status IN (16, 20, 21) GROUP BY f.id, f.status"""


FACT_VIEWS = {
    "f_officer": "SELECT a.*, CAST(s.employee_id AS VARCHAR) AS audit_man_id FROM credit_facility a LEFT JOIN credit_facility_status s ON s.credit_facility_id = a.id",
    "f_audit_approve": """
SELECT o.id, o.lease_organization, o.business_partner_id, o.industry_id, r.id AS reply_id, o.salesman_id, o.audit_man_id, o.credit_amount AS apply_amount,
  r.credit_amount AS reply_amount, o.update_time AS approve_time, r.create_time AS reply_time, r.irr, r.period
FROM f_officer o JOIN reply r ON r.credit_facility_id = o.id WHERE o.status = 16""",
    "f_audit_cancel": """
SELECT id, lease_organization, business_partner_id, industry_id, salesman_id, audit_man_id, credit_amount AS apply_amount, update_time AS cancel_time
FROM f_officer WHERE status = 21""",
    "f_audit_reject": """
SELECT id, lease_organization, business_partner_id, industry_id, salesman_id, audit_man_id, credit_amount AS apply_amount, update_time AS reject_time
FROM f_officer WHERE status = 20""",
    "f_credit_add": """
SELECT c.id, c.credit_facility_id, c.create_time AS add_time, a.apply_amount, a.reply_amount, c.credit_amount
FROM credit c JOIN f_audit_approve a ON a.id = c.credit_facility_id""",
    "f_credit_occupy": """
SELECT c.id, c.credit_facility_id, c.credit_occupy_time AS occupy_time, a.apply_amount, a.reply_amount, c.credit_amount
FROM credit c JOIN f_audit_approve a ON a.id = c.credit_facility_id WHERE c.credit_occupy_time IS NOT NULL""",
    "f_contract_produced": """
SELECT c.contract_id AS id, c.id AS credit_id, c.credit_facility_id, c.contract_produce_time AS produced_time, a.apply_amount, a.reply_amount, c.credit_amount
FROM credit c JOIN f_audit_approve a ON a.id = c.credit_facility_id WHERE c.contract_produce_time IS NOT NULL""",
    "f_lease_sign": """
SELECT t.id, t.credit_id, p.credit_facility_id, t.signed_time, p.apply_amount, p.reply_amount, p.credit_amount
FROM contract t JOIN f_contract_produced p ON p.credit_id = t.credit_id WHERE t.signed_time IS NOT NULL""",
    "f_lease_execution": """
SELECT t.id, t.credit_id, p.credit_facility_id, t.execution_time, p.apply_amount, p.reply_amount, p.credit_amount
FROM contract t JOIN f_contract_produced p ON p.credit_id = t.credit_id WHERE t.execution_time IS NOT NULL""",
}
_SECOND = "'%Y-%m-%d %H:%M:%S'"


def fact_sql(fact: str) -> str:
    cells = [f"strftime({c}, {_SECOND}) AS {c}" if c.endswith("_time") else c for c in S.FACTS[fact]]
    return with_views(f"SELECT {', '.join(cells)} FROM f_{fact}", FACT_VIEWS)


# Summaries ----------------------------------------------------------------------


def summary_query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_names(summarize(fact_table(spark, sf_dir, SUMMARIES[name].fact), name), name, spark, sf_dir)

    return query


def with_names(summary: DataFrame, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary with the dimension names its job adds, if any."""
    if name.startswith("ind_org"):
        return with_hierarchies(summary, *(lease_view(spark, sf_dir, f"dim_{d}") for d in ("industry", "employee", "department")))
    if name.startswith("audit_man"):
        return with_officer_name(summary, lease_view(spark, sf_dir, "dim_employee").withColumn("id", F.col("id").cast("string")))
    return summary


def flat_sql(kind: str) -> str:
    p, s = f"{kind}_name", f"superior_{kind}_id"
    return (
        f"SELECT a.id AS {kind}3_id, a.{p} AS {kind}3_name, a.{s} AS {kind}2_id, b.{p} AS {kind}2_name, b.{s} AS {kind}1_id, c.{p} AS {kind}1_name "
        f"FROM dim_{kind} a LEFT JOIN dim_{kind} b ON b.id = a.{s} LEFT JOIN dim_{kind} c ON c.id = b.{s}"
    )


def window_sql(name: str) -> str:
    """The summary without names, over the fact's view."""
    spec = SUMMARIES[name]
    keys = [("industry_id AS industry3_id" if k == "industry3_id" else k) for k in spec.keys]
    bare = [k.split(" AS ")[0] for k in keys]
    bucket = f"time_bucket(INTERVAL '10 seconds', {spec.time})"
    cells = [f"strftime({bucket}, {_SECOND}) AS stt", f"strftime({bucket} + INTERVAL '10 seconds', {_SECOND}) AS edt", f"strftime({bucket}, '%Y-%m-%d') AS cur_date", *keys, "count(*) AS apply_count"]
    cells += [f"CAST(sum({c}) AS DECIMAL(16,2)) AS {c}" for c in spec.sums]
    where = " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in spec.required) if spec.required else ""
    return f"SELECT {', '.join(cells)} FROM f_{spec.fact}{where} GROUP BY {', '.join([bucket, *bare])}"


def enriched_sql(name: str) -> str:
    spec = SUMMARIES[name]
    measures = ", ".join(f"w.{c}" for c in ("apply_count", *spec.sums))
    if name.startswith("ind_org"):
        i = ", ".join(f"w.industry3_id, i.industry3_name" if n == 3 else f"i.industry{n}_id, i.industry{n}_name" for n in (3, 2, 1))
        d = ", ".join(f"e.department_id AS department3_id, d.department3_name" if n == 3 else f"d.department{n}_id, d.department{n}_name" for n in (3, 2, 1))
        return (
            f"SELECT w.stt, w.edt, w.cur_date, w.lease_organization, {i}, w.salesman_id, e.name AS salesman_name, {d}, {measures} FROM summed w "
            f"LEFT JOIN flat_industry i ON i.industry3_id = w.industry3_id LEFT JOIN dim_employee e ON e.id = w.salesman_id "
            f"LEFT JOIN flat_department d ON d.department3_id = e.department_id"
        )
    if name.startswith("audit_man"):
        return f"SELECT w.stt, w.edt, w.cur_date, w.audit_man_id, e.name AS audit_man_name, {measures} FROM summed w LEFT JOIN dim_employee e ON CAST(e.id AS VARCHAR) = w.audit_man_id"
    return "SELECT * FROM summed"


def _summary_views(name: str) -> dict[str, str]:
    return FACT_VIEWS | {"flat_industry": flat_sql("industry"), "flat_department": flat_sql("department"), "summed": window_sql(name)}


def summary_sql(name: str) -> str:
    return with_views(enriched_sql(name), _summary_views(name))


def ads_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled_up(summary_query("ind_org_salesman_approval")(spark, sf_dir))


def _rollup_sql() -> str:
    views = _summary_views("ind_org_salesman_approval") | {"named": enriched_sql("ind_org_salesman_approval")}
    cells = ", ".join(f"CAST(sum({c}) AS DECIMAL(26,2)) AS {c}" for c in ("apply_amount", "reply_amount"))
    return with_views(
        "SELECT CASE WHEN grouping(industry1_name) = 0 THEN 'industry' WHEN grouping(department1_name) = 0 THEN 'department' ELSE 'direction' END AS level, "
        f"coalesce(industry1_name, department1_name, lease_organization) AS name, CAST(sum(apply_count) AS BIGINT) AS apply_count, {cells} "
        "FROM named GROUP BY GROUPING SETS ((industry1_name), (department1_name), (lease_organization))",
        views,
    )


# Sources and dimensions ---------------------------------------------------------


def _parsed(log: DataFrame) -> DataFrame:
    return parse_changes(as_json(log))[0]


def _mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lease log, with every seventh credit's key gone, beside other tables."""
    lost = (F.col("table") == "credit") & (F.col("xoffset") % 7 == 0)
    log = lease_log(spark, sf_dir).withColumn("data", F.when(lost, F.map_filter("data", lambda k, _: k != "credit_facility_id")).otherwise(F.col("data")))
    return log.unionByName(dimension_log(spark, sf_dir))


def ods_fact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fact_changes(_parsed(_mixed_log(spark, sf_dir)))
    return kept.groupBy(F.col("table").alias("source_table"), F.col("type").alias("change_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("xoffset")).alias("ids"))


def ods_split_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, contracts = split_contracts(fact_changes(_parsed(_mixed_log(spark, sf_dir))))
    sides = rest.withColumn("side", F.lit("application")).unionByName(contracts.withColumn("side", F.lit("contract")))
    return sides.groupBy("side", F.col("table").alias("source_table")).agg(F.count(F.lit(1)).alias("n"))


ODS_VIEWS = {
    "kept": """
SELECT 'credit_facility_status' AS source_table, 'insert' AS change_type, credit_facility_id AS x FROM credit_facility_status
UNION ALL SELECT 'credit_facility', 'update', id FROM credit_facility
UNION ALL SELECT 'reply', 'insert', id FROM reply
UNION ALL SELECT 'credit', 'insert', id FROM credit WHERE id % 7 <> 0
UNION ALL SELECT 'credit', 'update', id FROM credit WHERE id % 7 <> 0 AND credit_occupy_time IS NOT NULL
UNION ALL SELECT 'credit', 'update', id FROM credit WHERE id % 7 <> 0 AND contract_produce_time IS NOT NULL
UNION ALL SELECT 'contract', 'update', id FROM contract WHERE signed_time IS NOT NULL
UNION ALL SELECT 'contract', 'update', id FROM contract WHERE execution_time IS NOT NULL"""
}


def _config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.DIMENSION_CONFIG, S.TABLE_PROCESS)


def dim_membership_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dimensions.dimension_changes(_parsed(dimension_log(spark, sf_dir)), _config(spark))
    row = F.col("row")
    return found.select("sink_table", F.col("type").alias("change_type"), "xid", row["id"].alias("id"), row["name"].alias("name"), F.size(row).alias("n_columns"))


def dim_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = dimensions.newest_per_key(dimensions.dimension_changes(_parsed(dimension_log(spark, sf_dir)), _config(spark)))
    columns = next(c[3] for c in S.DIMENSION_CONFIG if c[0] == "employee")
    changed = dimensions.dimension_rows(newest.where(F.col("sink_table") == "dim_employee"), columns)
    before = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(1000000)).cast("string").alias("key"))
    current = before.select("key", *[F.lit("").alias(c) if c != "id" else F.col("key").alias("id") for c in columns.split(",")])
    table = dimension_table(spark, new_path(spark, "dim-employee"), dimensions.column_names(columns))
    table.append(current, 0)
    table.compact()
    table.append(changed, 1)  # stands in the log beside the compacted parts
    return table.read().select("key", "id", "name", "department_id")


DIM_VIEWS = {
    "log": """
SELECT 'dim_employee' AS sink_table, 'bootstrap-insert' AS change_type, 1 AS xid, s_suppkey AS id, s_name AS name, 3 AS n_columns, 1000 + s_nationkey AS department_id FROM supplier
UNION ALL SELECT 'dim_employee', 'update', 2, s_suppkey, s_name || ' moved', 3, 1000 + s_nationkey FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'dim_employee', 'delete', 3, s_suppkey, s_name, 3, 1000 + s_nationkey FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT 'dim_employee', 'insert', 4, s_suppkey, NULL, 3, 1000 + s_nationkey FROM supplier WHERE s_suppkey % 21 = 0
UNION ALL SELECT 'dim_business_partner', 'insert', 1, c_custkey, c_name, 2, NULL FROM customer
UNION ALL SELECT 'dim_business_partner', 'update', 2, c_custkey, c_name || ' again', 2, NULL FROM customer WHERE c_custkey % 4 = 0""",
    "newest": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY xid DESC) AS n FROM log WHERE sink_table = 'dim_employee'",
    "before": "SELECT s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1000000 END AS key FROM supplier",
}
_UPSERT_SQL = """
SELECT CAST(key AS VARCHAR) AS key, CAST(key AS VARCHAR) AS id, '' AS name, '' AS department_id FROM before WHERE key NOT IN (SELECT id FROM newest)
UNION ALL SELECT CAST(id AS VARCHAR), CAST(id AS VARCHAR), coalesce(name, ''), CAST(department_id AS VARCHAR) FROM newest WHERE n = 1 AND change_type <> 'delete'"""


def dim_flat(kind: str) -> Query:
    return lambda spark, sf_dir: dimensions.flattened(lease_view(spark, sf_dir, f"dim_{kind}"), f"{kind}_name", f"superior_{kind}_id", kind)


# Raw events and the upsert table -------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def events_tumbling(keys: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir).withColumn("value", F.col("value").cast(S.MONEY))
        return tumbling_summary(rows, "ts", keys, ("value",))

    return query


def events_sql(keys: tuple[str, ...], where: str = "") -> str:
    bucket = "time_bucket(INTERVAL '10 seconds', ts)"
    cells = [f"strftime({bucket}, {_SECOND}) AS stt", f"strftime({bucket} + INTERVAL '10 seconds', {_SECOND}) AS edt", f"strftime({bucket}, '%Y-%m-%d') AS cur_date", *keys, "count(*) AS apply_count", "CAST(sum(CAST(value AS DECIMAL(16,2))) AS DECIMAL(16,2)) AS value"]
    return f"SELECT {', '.join(cells)} FROM events{where} GROUP BY {', '.join([bucket, *keys])}"


def dws_upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums by event type, then a second batch that replaces those of users
    with an even id: the newest row of a key wins."""
    rows = _events(spark, sf_dir)

    def daily(part: DataFrame) -> DataFrame:
        return part.groupBy(day_of(F.col("ts")).alias("cur_date"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast(S.MONEY)).cast(S.MONEY).alias("value"))

    first = daily(rows)
    table = day_table(spark, new_path(spark, "upsert"), ddl(first), ["cur_date", "event_type"])
    table.append(first, 0)
    table.compact()
    table.append(daily(rows.where("user_id % 2 = 0 AND event_type <> 'click'")), 1)
    return table.read().select("cur_date", "event_type", "n", "value")


_UPSERT_EVENTS_SQL = """
WITH daily AS (
  SELECT strftime(ts, '%Y-%m-%d') AS cur_date, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(16,2))) AS DECIMAL(16,2)) AS value FROM events GROUP BY 1, 2
), newer AS (
  SELECT strftime(ts, '%Y-%m-%d') AS cur_date, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(16,2))) AS DECIMAL(16,2)) AS value
  FROM events WHERE user_id % 2 = 0 AND event_type <> 'click' GROUP BY 1, 2
)
SELECT * FROM newer UNION ALL SELECT d.* FROM daily d LEFT JOIN newer n USING (cur_date, event_type) WHERE n.n IS NULL
"""


def dws_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by day in a table partitioned by day, then cut to ten days
    before and five after the middle of January 2024."""
    days = _events(spark, sf_dir).groupBy(day_of(F.col("ts")).alias("cur_date")).agg(F.count(F.lit(1)).alias("n"))
    table = day_table(spark, new_path(spark, "retention"), ddl(days), ["cur_date"])
    table.append(days, 0)
    drop_old_days(table, RETENTION_DAY, keep=10, ahead=5)
    return table.read().select("cur_date", "n")


RETENTION_DAY = "2024-01-15"
_RETENTION_SQL = f"""
SELECT strftime(ts, '%Y-%m-%d') AS cur_date, count(*) AS n FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '{RETENTION_DAY}' - 10 AND DATE '{RETENTION_DAY}' + 5 GROUP BY 1"""


def dws_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as lines of JSON with the names of the sink's records, written as
    text, read and parsed again."""
    summary = summary_query("credit_add")(spark, sf_dir)
    target = new_path(spark, "json-text")
    json_lines(summary, camel_case).write.option("maxRecordsPerFile", 10_000).text(target)
    read = spark.read.text(target).select(F.from_json("value", renamed(summary, camel_case).schema).alias("r")).select("r.*")
    return renamed(read, snake_case)


# Streams ------------------------------------------------------------------------


def _log_files(spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """The lease log, or a topic of it: the changes of ``tables``."""
    path = new_path(spark, "change-log")
    write_log(as_json(lease_log(spark, sf_dir, tables) if tables else lease_log(spark, sf_dir)), path)
    return path


def _finished(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


#: The jobs that write the facts, in order, and a topic of the log for each: the changes of
#: its tables.
TOPICS = jobs.JOINED_TABLES | {"contracts": jobs.CONTRACT_TABLES}
FACT_JOBS = tuple(TOPICS)


def _run_fact_job(spark: SparkSession, sf_dir: str, job: str, layer: str, checkpoint: str, write: Callable[..., str] | None = None, files_per_batch: int | None = None) -> None:
    """One of ``FACT_JOBS`` on its topic, which goes with the job's checkpoint when all of
    it has been read: what is on disk is one topic at a time, and the layer."""
    log = (write or _log_files)(spark, sf_dir, *TOPICS[job])
    if job == "contracts":
        _finished(jobs.contract_job(spark, log, layer, f"{checkpoint}/{job}", available_now=True))
    else:
        for query in jobs.joined_fact_jobs(spark, log, layer, f"{checkpoint}/{job}", available_now=True, files_per_batch=files_per_batch, only=(job,)):
            _finished(query)
    drop_path(spark, log)
    drop_path(spark, f"{checkpoint}/{job}")


def _facts_by_stream(spark: SparkSession, sf_dir: str, mode: str) -> str:
    """``complete`` by the chained jobs; ``keyed`` and ``strict`` by the state machine."""
    layer, checkpoint = new_path(spark, "facts"), new_path(spark, "facts-checkpoint")
    if mode == "complete":
        for job in jobs.JOINED_JOBS:
            _run_fact_job(spark, sf_dir, job, layer, checkpoint)
    else:
        log = _log_files(spark, sf_dir)
        _finished(jobs.fact_job(spark, log, layer, checkpoint, {"keyed": "complete"}.get(mode, mode), available_now=True))
    return layer


def stream_fact_lifecycle(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        layer = _facts_by_stream(spark, sf_dir, mode)
        return reduce(DataFrame.unionByName, [_brief(jobs.facts_of(spark, layer, k), k) for k in jobs.APPLICATION_FACTS])

    return query


def _brief(df: DataFrame, kind: str) -> DataFrame:
    time = next(c for c in S.FACTS[kind] if c.endswith("_time"))
    officer = F.col("audit_man_id") if "audit_man_id" in df.columns else F.lit(None).cast("string")
    reply = F.col("reply_amount") if "reply_amount" in df.columns else F.lit(None).cast(S.MONEY)
    return df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.substring(F.col(time), 1, 19).alias("at"), officer.alias("audit_man_id"), "apply_amount", reply.alias("reply_amount"))


def _brief_sql(kinds: tuple[str, ...]) -> str:
    parts = []
    for kind in kinds:
        columns = S.FACTS[kind]
        time = next(c for c in columns if c.endswith("_time"))
        officer = "audit_man_id" if "audit_man_id" in columns else "CAST(NULL AS VARCHAR)"
        reply = "reply_amount" if "reply_amount" in columns else "CAST(NULL AS DECIMAL(16,2))"
        parts.append(f"SELECT '{kind}' AS kind, CAST(id AS BIGINT) AS id, strftime({time}, {_SECOND}) AS at, {officer} AS audit_man_id, apply_amount, {reply} AS reply_amount FROM f_{kind}")
    return with_views("\nUNION ALL ".join(parts), FACT_VIEWS)


def stream_contract_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = _facts_by_stream(spark, sf_dir, "complete")
    _run_fact_job(spark, sf_dir, "contracts", layer, new_path(spark, "contract-checkpoint"))
    return reduce(DataFrame.unionByName, [_brief(jobs.facts_of(spark, layer, k), k) for k in jobs.CONTRACT_FACTS])


def stream_facts_out_of_order(joined: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts from a log dealt over files so that replies and credits come in
    other micro-batches than their applications, before or after them."""
    layer, checkpoint = (new_path(spark, f"facts-{x}") for x in ("layer", "checkpoint"))
    each = 2 * spark.sparkContext.defaultParallelism  # of three batches: a file is one task's
    write = partial(_shuffled_log, 3 * each)
    if joined:
        for job in jobs.JOINED_JOBS:
            _run_fact_job(spark, sf_dir, job, layer, checkpoint, write, each)
    else:
        _finished(jobs.fact_job(spark, write(spark, sf_dir), layer, checkpoint, available_now=True, files_per_batch=each))
    return reduce(DataFrame.unionByName, [_brief(jobs.facts_of(spark, layer, k), k) for k in jobs.APPLICATION_FACTS])


def _shuffled_log(files: int, spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """The lease log, or a topic of it, dealt over files by application, replies and
    credits apart from what is first."""
    path = new_path(spark, "shuffled-log")
    lines = lease_log(spark, sf_dir, tables) if tables else lease_log(spark, sf_dir)
    first = F.col("table").isin("credit_facility", "credit_facility_status")
    app = F.coalesce(F.col("data")["credit_facility_id"], F.col("data")["id"])
    file = F.when(first, F.pmod(F.xxhash64(app), F.lit(files))).otherwise(F.pmod(F.xxhash64("table", "type", app), F.lit(files)))
    dealt = lines.select(F.to_json(F.struct(*lines.columns)).alias("value"), file.cast("int").alias("file"))
    write_log(dealt.repartitionById(files, F.col("file")).select("value"), path)
    return path


_LAYERS: dict[tuple, tuple[str, str, set[str]]] = {}
#: The job that writes each fact; it reads what those before it write.
WRITTEN_BY = {"audit_cancel": "ends", "audit_reject": "ends", "audit_approve": "approvals", "lease_sign": "contracts", "lease_execution": "contracts"}


def _fact_layer(spark: SparkSession, sf_dir: str, fact: str) -> str:
    """The fact tables, as the fact and contract jobs write them: the summary jobs all
    read the same ones, as they would in production. Made anew if a file changed. The
    jobs that ``fact`` comes from have run, each once; others run when their facts are
    asked for."""
    files = []
    for name in BASE:
        fs, at = file_system(spark, f"{sf_dir}/{name}.parquet")
        found = fs.listStatus(at)
        files += sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in found)
    key = (spark.sparkContext.applicationId, *files)
    if key not in _LAYERS:
        _LAYERS[key] = (new_path(spark, "facts"), new_path(spark, "facts-checkpoint"), set())
    layer, checkpoint, done = _LAYERS[key]
    for job in FACT_JOBS[: FACT_JOBS.index(WRITTEN_BY.get(fact, "credits")) + 1]:
        if job in done:
            continue
        _run_fact_job(spark, sf_dir, job, layer, checkpoint)
        done.add(job)
    return layer


def stream_summary(name: str) -> Query:
    """The closed windows of a summary, by its streaming job from the fact tables,
    each batch enriched with the dimensions of that moment."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        layer, target = _fact_layer(spark, sf_dir, SUMMARIES[name].fact), new_path(spark, f"dws-{name}")
        wanted = summary_query(name)(spark, sf_dir).schema

        def enrich(batch: DataFrame) -> DataFrame:
            ids = [c for c in ("industry3_id", "salesman_id") if c in batch.columns]
            typed = batch.withColumns({c: F.col(c).cast("long") for c in ids})
            return with_names(typed, name, spark, sf_dir).select([F.col(f.name).cast(f.dataType) for f in wanted])

        _finished(jobs.summary_job(spark, name, layer, target, new_path(spark, "dws-checkpoint"), enrich, available_now=True))
        return jobs.read_summary(spark, name, target, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted))

    return query


def stream_ads_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application layer's closed days, by chained aggregations in one stream."""
    layer, target = _fact_layer(spark, sf_dir, SUMMARIES["ind_org_salesman_approval"].fact), new_path(spark, "ads")

    def enrich(windows: DataFrame) -> DataFrame:
        tables = (lease_view(windows.sparkSession, sf_dir, f"dim_{d}") for d in ("industry", "employee", "department"))
        industry, employee, department = (t.withColumn("id", F.col("id").cast("string")) if n < 2 else t for n, t in enumerate(tables))
        tops = dimensions.flattened(industry, "industry_name", "superior_industry_id", "industry").select("industry3_id", "industry1_name")
        above = dimensions.flattened(department, "department_name", "superior_department_id", "department").select("department3_id", "department1_name")
        officers = employee.join(above, employee["department_id"] == above["department3_id"], "left").select(F.col("id").alias("salesman_id"), "department1_name")
        return windows.join(tops, "industry3_id", "left").join(officers, "salesman_id", "left")

    _finished(jobs.rollup_job(spark, layer, target, new_path(spark, "ads-checkpoint"), enrich, available_now=True))
    schema = "cur_date string, level string, name string, apply_count long, apply_amount decimal(26,2), reply_amount decimal(26,2), batch string"
    return read_layer(spark, target, schema)


def _days_sql() -> str:
    name = "ind_org_salesman_approval"
    views = _summary_views(name) | {"named": enriched_sql(name)}
    latest = f"(SELECT max(approve_time) - INTERVAL '{SUMMARIES[name].delay}' FROM f_audit_approve)"
    cells = ", ".join(f"CAST(sum({c}) AS DECIMAL(26,2)) AS {c}" for c in ("apply_amount", "reply_amount"))
    parts = [
        f"SELECT cur_date, '{level}' AS level, {c} AS name, CAST(sum(apply_count) AS BIGINT) AS apply_count, {cells} FROM named WHERE CAST(cur_date AS DATE) + INTERVAL '1 day' <= {latest} GROUP BY cur_date, {c}"
        for level, c in (("industry", "industry1_name"), ("department", "department1_name"), ("direction", "lease_organization"))
    ]
    return with_views("\nUNION ALL ".join(parts), views)


def _closed_sql(name: str) -> str:
    spec = SUMMARIES[name]
    where = " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in spec.required) if spec.required else ""
    latest = f"(SELECT strftime(max({spec.time}) - INTERVAL '{spec.delay}', {_SECOND}) FROM f_{spec.fact}{where})"
    return with_views(f"SELECT * FROM ({enriched_sql(name)}) WHERE edt <= {latest}", _summary_views(name))


def stream_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, target = _log_files(spark, sf_dir), new_path(spark, "running-count")
    _finished(jobs.count_job(spark, log, target, new_path(spark, "count-checkpoint"), available_now=True))
    return spark.read.parquet(target).select("count")


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which some replies are cut short, some status rows have no table and
    some applications no type: messages by reason, and those that were parsed."""
    log, layer = new_path(spark, "broken-log"), new_path(spark, "quarantine")
    cut = (F.col("table") == "reply") & (F.col("xoffset") % 10 == 3)
    lines = lease_log(spark, sf_dir)
    lines = lines.withColumn("type", F.when((F.col("table") != "credit_facility") | (F.col("xoffset") % 10 != 5), F.col("type")))
    lines = lines.withColumn("table", F.when((F.col("table") != "credit_facility_status") | (F.col("xoffset") % 10 != 4), F.col("table")))
    value = F.to_json(F.struct(*lines.columns))
    write_log(lines.select(F.when(cut, F.substring(value, 1, 30)).otherwise(value).alias("value")), log)
    _finished(jobs.quarantine_job(spark, log, layer, new_path(spark, "quarantine-checkpoint"), available_now=True))
    bad = read_layer(spark, layer, "value string, reason string, batch string").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    good = parse_changes(read_values(spark, log))[0].agg(F.lit("parsed").alias("reason"), F.count(F.lit(1)).alias("n"))
    return bad.unionByName(good)


_QUARANTINE_SQL = """
SELECT 'no JSON' AS reason, count(*) AS n FROM reply WHERE id % 10 = 3
UNION ALL SELECT 'no table', count(*) FROM credit_facility_status WHERE credit_facility_id % 10 = 4
UNION ALL SELECT 'no type', count(*) FROM credit_facility WHERE id % 10 = 5
UNION ALL SELECT 'parsed', (SELECT count(*) FROM credit_facility_status WHERE credit_facility_id % 10 <> 4) + (SELECT count(*) FROM credit_facility WHERE id % 10 <> 5)
  + (SELECT count(*) FROM reply WHERE id % 10 <> 3) + (SELECT count(*) + count(credit_occupy_time) + count(contract_produce_time) FROM credit) + (SELECT count(signed_time) + count(execution_time) FROM contract)"""


def stream_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of added credits from a layer whose facts are all delivered twice, the
    second time in another order and other files."""
    layer, once, target = (new_path(spark, x) for x in ("twice", "once", "dws-twice"))
    facts = _times_as_text(fact_table(spark, sf_dir, "credit_add"))
    payload = F.to_json(F.struct([F.when(F.lit(c.endswith("_time")), F.concat(F.col(c), F.lit(".000000"))).otherwise(F.col(c).cast("string")).alias(c) for c in facts.columns]))
    facts.select(F.lit("credit_add").alias("kind"), payload.alias("payload")).write.parquet(once)
    rows = spark.read.parquet(once)  # else the facts are joined again for the second time and for its order
    rows.unionByName(rows.orderBy(F.xxhash64("payload"))).write.parquet(f"{layer}/credit_add")
    schema = "stt string, edt string, cur_date string, apply_count long, apply_amount decimal(16,2), reply_amount decimal(16,2), credit_amount decimal(16,2)"
    _finished(jobs.summary_job(spark, "credit_add", layer, target, new_path(spark, "twice-checkpoint"), available_now=True))
    return jobs.read_summary(spark, "credit_add", target, schema)


_COUNT_SQL = """
SELECT (SELECT count(*) FROM credit_facility_status) + (SELECT count(*) FROM credit_facility) + (SELECT count(*) FROM reply)
  + (SELECT count(*) + count(credit_occupy_time) + count(contract_produce_time) FROM credit) + (SELECT count(signed_time) + count(execution_time) FROM contract) AS count"""


def stream_dim_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension tables kept by the configuration's own stream: tables are created,
    renamed and dropped between two runs, each of which reads its part of the log."""
    config, layer, log, tables, marks, log_marks = (new_path(spark, f"dims-{x}") for x in ("config", "config-layer", "log", "tables", "config-checkpoint", "checkpoint"))
    lines = dimension_log(spark, sf_dir)
    for run in (1, 2):
        spark.createDataFrame([(x,) for x in config_lines(run)], "value string").coalesce(1).write.mode("append").text(config)
        _finished(jobs.config_job(spark, config, layer, tables, marks, available_now=True))
        write_log(as_json(lines.where(F.col("xid") <= 1 if run == 1 else F.col("xid") > 1)), log, "append")
        _finished(jobs.dimension_job(spark, log, layer, tables, log_marks, available_now=True))
    # business_partner moved to a new table after its rows had come; partner_note is gone
    found = []
    for table, columns in (("dim_employee", ["id", "name"]), ("dim_business_partner", ["id"]), ("dim_partner", ["id", "name"]), ("dim_partner_note", ["id"])):
        if exists(spark, f"{tables}/{table}"):
            rows = dimension_table(spark, f"{tables}/{table}", columns).read()
            name = F.col("name") if "name" in columns else F.lit(None).cast("string")
            found.append(rows.select(F.lit(table).alias("sink_table"), "key", name.alias("name")))
    return reduce(DataFrame.unionByName, found)


_DIM_CONFIG_SQL = """
SELECT 'dim_employee' AS sink_table, CAST(id AS VARCHAR) AS key, coalesce(name, '') AS name FROM newest WHERE n = 1 AND change_type <> 'delete'
UNION ALL SELECT 'dim_partner', CAST(c_custkey AS VARCHAR), c_name || ' again' FROM customer WHERE c_custkey % 4 = 0"""


def stream_snapshot_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees from a snapshot and a log that no longer has their first rows but
    holds changes that the snapshot has too; the configuration likewise. Both jobs are
    started twice, with the same snapshots, and read a part of the log each."""
    config, layer, log, tables, marks, log_marks = (new_path(spark, f"fence-{x}") for x in ("config", "config-layer", "log", "tables", "config-checkpoint", "checkpoint"))
    lines = dimension_log(spark, sf_dir).where((F.col("table") == "employee") & (F.col("xid") >= 2))
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit(" moved"))).otherwise(F.col("s_name"))
    snapshot = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), name.alias("name"), (1000 + F.col("s_nationkey")).alias("department_id"))
    fence = (lines.agg(F.max("ts")).first()[0] or 0, 2, 2**63 - 1)
    configured = spark.createDataFrame([tuple(json.loads(x)["after"].values()) for x in config_lines(1)], S.TABLE_PROCESS)
    for run in (1, 2):
        spark.createDataFrame([(x,) for x in config_lines(run)], "value string").coalesce(1).write.mode("append").text(config)
        _finished(jobs.config_job(spark, config, layer, tables, marks, available_now=True, snapshot=(configured, 150)))
        write_log(as_json(lines.where(F.col("xid") <= 3 if run == 1 else F.col("xid") > 3)), log, "append")
        _finished(jobs.dimension_job(spark, log, layer, tables, log_marks, available_now=True, snapshots={"employee": (snapshot, fence)}))
    return dimension_table(spark, f"{tables}/dim_employee", ["id", "name"]).read().select("key", "name")


_FENCE_SQL = "SELECT CAST(id AS VARCHAR) AS key, coalesce(name, '') AS name FROM newest WHERE n = 1 AND change_type <> 'delete'"


def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, stopped and started again from its checkpoint with all
    of them once more: the second time they are late, and closed windows stay."""
    source, target, checkpoint = (new_path(spark, f"late-{x}") for x in ("source", "target", "checkpoint"))
    rows = _events(spark, sf_dir).select("ts", F.col("value").cast(S.MONEY).alias("value"))
    for run in ("first", "second"):
        again = rows if run == "first" else rows.join(rows.agg(F.max("ts").alias("_last")), F.col("ts") < F.col("_last") - F.expr("INTERVAL 60 SECONDS"), "inner").drop("_last")
        again.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source).withWatermark("ts", "5 seconds")
        summary = tumbling_summary(stream, "ts", (), ("value",))
        writer = summary.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
        _finished(writer.trigger(availableNow=True).start())
    return spark.read.schema(summary.schema).parquet(target)


_LATE_SQL = f"SELECT * FROM ({events_sql(())}) WHERE edt <= (SELECT strftime(max(ts) - INTERVAL '5 seconds', {_SECOND}) FROM events)"


def _plain(query: Query) -> Query:
    """Decimals as text, so that engines compare them digit by digit with their scale."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind.startswith("decimal")})

    return run


def _decimals(name: str) -> dict[str, str]:
    """The decimal columns of a query's result and their types."""
    kind, _, rest = name.partition("_")
    money = S.MONEY
    if kind == "fact" and rest in S.FACTS:
        return {c: S.RATE if c == "irr" else money for c in S.FACTS[rest] if c.endswith("_amount") or c == "irr"}
    summary = rest.removeprefix("dws_")
    if summary in SUMMARIES:
        return dict.fromkeys(SUMMARIES[summary].sums, money)
    if name in ("dws_json_text", "stream_redelivered"):
        return dict.fromkeys(SUMMARIES["credit_add"].sums, money)
    if "lifecycle" in name or "out_of_order" in name or name.endswith("ads_rollup"):
        return dict.fromkeys(("apply_amount", "reply_amount"), "decimal(26,2)" if name.endswith("ads_rollup") else money)
    return {"value": money} if kind == "events" or name in ("dws_upsert_replace", "stream_late_drop") else {}


def _plain_sql(name: str, sql: str) -> str:
    found = ", ".join(f"CAST(CAST({c} AS {kind}) AS VARCHAR) AS {c}" for c, kind in _decimals(name).items())
    return f"SELECT * REPLACE ({found}) FROM ({sql})" if found else sql


QUERIES: dict[str, Query] = {
    "ods_fact_filter": ods_fact_filter,
    "ods_split_contract": ods_split_contract,
    "dim_membership_prune": dim_membership_prune,
    "dim_latest_upsert": dim_latest_upsert,
    "dim_industry_flat": dim_flat("industry"),
    "dim_department_flat": dim_flat("department"),
    **{f"fact_{f}": fact_query(f) for f in S.FACTS},
    **{f"dws_{n}": summary_query(n) for n in SUMMARIES},
    "dws_upsert_replace": dws_upsert_replace,
    "events_tumbling": events_tumbling(()),
    "events_tumbling_by_type": events_tumbling(("event_type",)),
    "fact_officer_as_of": fact_officer_as_of,
    "dws_retention": dws_retention,
    "dws_json_text": dws_json_text,
    "stream_dim_config": stream_dim_config,
    "stream_facts_out_of_order": partial(stream_facts_out_of_order, True),
    "stream_facts_out_of_order_keyed": partial(stream_facts_out_of_order, False),
    "stream_quarantine": stream_quarantine,
    "stream_redelivered": stream_redelivered,
    "stream_running_count": stream_running_count,
    **{f"stream_dws_{n}": stream_summary(n) for n in SUMMARIES},
    "stream_late_drop": stream_late_drop,
    "stream_snapshot_fence": stream_snapshot_fence,
    "stream_ads_rollup": stream_ads_rollup,
    "stream_fact_lifecycle_complete": stream_fact_lifecycle("complete"),
    "stream_fact_lifecycle_keyed": stream_fact_lifecycle("keyed"),
    "stream_fact_lifecycle_strict": stream_fact_lifecycle("strict"),
    "stream_contract_lifecycle": stream_contract_lifecycle,
    "ads_rollup": ads_rollup,
}
QUERIES = {name: _plain(query) for name, query in QUERIES.items()}

SQL: dict[str, str] = {
    "ods_fact_filter": with_views("SELECT source_table, change_type, count(*) AS n, CAST(sum(x) AS BIGINT) AS ids FROM kept GROUP BY 1, 2", ODS_VIEWS),
    "ods_split_contract": with_views("SELECT CASE WHEN source_table = 'contract' THEN 'contract' ELSE 'application' END AS side, source_table, count(*) AS n FROM kept GROUP BY 1, 2", ODS_VIEWS),
    "dim_membership_prune": with_views("SELECT sink_table, change_type, CAST(xid AS BIGINT) AS xid, CAST(id AS VARCHAR) AS id, name, n_columns FROM log", DIM_VIEWS),
    "dim_latest_upsert": with_views(_UPSERT_SQL, DIM_VIEWS),
    "dim_industry_flat": with_views(flat_sql("industry")),
    "dim_department_flat": with_views(flat_sql("department")),
    **{f"fact_{f}": fact_sql(f) for f in S.FACTS},
    **{f"dws_{n}": summary_sql(n) for n in SUMMARIES},
    "dws_upsert_replace": _UPSERT_EVENTS_SQL,
    "events_tumbling": events_sql(()),
    "events_tumbling_by_type": events_sql(("event_type",)),
    "fact_officer_as_of": with_views(_OFFICER_SQL, _OFFICER_VIEWS),
    "dws_retention": _RETENTION_SQL,
    "dws_json_text": summary_sql("credit_add"),
    "stream_dim_config": with_views(_DIM_CONFIG_SQL, DIM_VIEWS),
    "stream_facts_out_of_order": _brief_sql(jobs.APPLICATION_FACTS),
    "stream_facts_out_of_order_keyed": _brief_sql(jobs.APPLICATION_FACTS),
    "stream_quarantine": with_views(_QUARANTINE_SQL),
    "stream_redelivered": _closed_sql("credit_add"),
    "stream_running_count": with_views(_COUNT_SQL),
    **{f"stream_dws_{n}": _closed_sql(n) for n in SUMMARIES},
    "stream_late_drop": _LATE_SQL,
    "stream_snapshot_fence": with_views(_FENCE_SQL, DIM_VIEWS),
    "stream_ads_rollup": _days_sql(),
    "stream_fact_lifecycle_complete": _brief_sql(jobs.APPLICATION_FACTS),
    "stream_fact_lifecycle_keyed": _brief_sql(jobs.APPLICATION_FACTS),
    # in-order changes: the credit's first fact uses its approval up
    "stream_fact_lifecycle_strict": _brief_sql(("audit_approve", "audit_cancel", "audit_reject", "credit_add")),
    "stream_contract_lifecycle": _brief_sql(jobs.CONTRACT_FACTS),
    "ads_rollup": _rollup_sql(),
}
SQL = {name: _plain_sql(name, sql) for name, sql in SQL.items()}
