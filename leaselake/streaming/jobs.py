"""The streaming jobs: dimensions, facts, contracts and summaries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaselake import schemas as S
from leaselake.functions import event_time
from leaselake.operators.dimensions import column_names, config_actions, dimension_changes, dimension_rows, newest_per_key
from leaselake.operators.windows import SUMMARIES, rolled_up_days, summarize
from leaselake.scratch import NO_LEFTOVERS, drop_path, file_system, with_conf
from leaselake.sources.changelog import about, after_fences, config_snapshot, current_config, fact_changes, parse_changes, parse_config, read_values, snapshot_changes
from leaselake.streaming.joins import (
    EARLY_APPROVAL,
    EARLY_CREDIT,
    EARLY_REPLY,
    OFFICER,
    WAITING,
    application_ends,
    approval_sides,
    approval_sides_before,
    approvals,
    approvals_met,
    credit_sides,
    credit_sides_before,
    credit_steps,
    credits_met,
)
from leaselake.streaming.lifecycle import (
    APPLICATION_CELLS,
    APPROVED,
    CONTRACT_CELLS,
    KEEP_TTL_MS,
    ROCKSDB,
    STASH_TTL_MS,
    application_facts,
    contract_facts,
    expiry,
    typed_facts,
)
from leaselake.streaming.sinks import append_batch, batch_name, fan_out, has_batch, kept_fence, read_layer
from leaselake.streaming.tables import LogTable, day_table, ddl, dimension_table, drop_old_days, hash_part

TRIGGER = "10 seconds"
#: How far apart in event time the sides of a stream-stream join may be.
PATIENCE = "400 days"
APPLICATION_FACTS = ("audit_approve", "audit_cancel", "audit_reject", "credit_add", "credit_occupy", "contract_produced")
CONTRACT_FACTS = ("lease_sign", "lease_execution")
#: The jobs of ``joined_fact_jobs`` in order, each of which reads those before it, and the
#: tables whose changes each of them takes; those of ``contract_job``.
JOINED_TABLES = {"ends": ("credit_facility", "credit_facility_status"), "approvals": ("reply",), "credits": ("credit",)}
JOINED_JOBS = tuple(JOINED_TABLES)
CREDIT_FACTS = ("credit_add", "credit_occupy", "contract_produced")
CONTRACT_TABLES = ("contract",)
PAYLOAD = "kind string, payload string, batch string"
#: Most partitions of a job's state, if the cluster has not over half as many cores: each
#: opens stores and, for a machine, starts a Python worker in every batch, and a
#: store keeps what it holds on disk.
STATE_PARTS = 24


def job_session(spark: SparkSession) -> SparkSession:
    """A session for a job: the sources' zone and a state store that the lifecycle
    processors can use. The caller's session stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", S.SOURCE_ZONE)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.shuffle.partitions", min(wanted, max(STATE_PARTS, 2 * spark.sparkContext.defaultParallelism)))
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch stores its changes, not its stores
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")  # no lookup before each write
    for k, v in NO_LEFTOVERS.items():
        session.conf.set(k, v)
    return session


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()


def _expiry(cells: dict, available_now: bool, early: int | None, kept: int | None) -> dict[str, int]:
    """State expires in jobs that run on; a timer would keep a bounded run going."""
    return {} if available_now else expiry(cells, early, kept)


def config_job(spark: SparkSession, log: str, layer: str, tables: str, checkpoint: str, available_now: bool = False, snapshot: tuple[DataFrame, int] | None = None) -> StreamingQuery:
    """Configuration changes to the table ``layer``, creating and dropping the
    dimension tables under ``tables`` as they ask. A batch that runs again after it
    was marked does nothing; one that died before leaves the tables it made alone.
    ``snapshot``: the configuration's rows (``read_config_table``) and the time in ms up
    to which they hold all changes; they come first, and once. Changes up to then are
    passed over, those without a time are not."""
    session = job_session(spark)
    changes = parse_config(read_values(session, log, streaming=True))
    if snapshot is not None:
        (fence,) = kept_fence(session, f"{layer}_fence", (snapshot[1],))
        changes = changes.where(F.col("ts_ms").isNull() | (F.col("ts_ms") > fence))

    def write(batch: DataFrame, batch_id: int) -> None:
        if has_batch(session, layer, batch_id):
            return
        made_by = batch_name(session, batch_id)
        for name, columns, dropped in config_actions(batch):
            table = dimension_table(session, f"{tables}/{name}", columns or [])
            if columns is None:
                table.drop()
                continue
            if dropped:
                table.drop(unless_made_by=made_by)
            table.create(made_by if dropped else "")
        append_batch(batch, layer, batch_id)

    if snapshot is not None:
        write(config_snapshot(snapshot[0], fence), 0)  # a batch of no stream
    return _start(changes, write, checkpoint, available_now)


def dimension_job(
    spark: SparkSession,
    log: str,
    config: str | Callable[[], DataFrame],
    tables: str,
    checkpoint: str,
    available_now: bool = False,
    snapshots: dict[str, tuple[DataFrame, tuple[int, int, int]]] | None = None,
) -> StreamingQuery:
    """Keeps the dimension tables under ``tables`` current: a batch appends its newest
    row of each key, and parts with many changes are compacted. The configuration (the
    layer that ``config_job`` writes, or a function that gives it) is read anew for
    each batch, so a change of it holds from the next batch on. Tables that a batch
    does not touch are not written.

    ``snapshots``: by source table its rows (``read_snapshot``) and the log's position
    (ts, xid, xoffset) up to which they hold all changes; a position taken before the
    rows are read is safe. Rows come first, and once; changes up to the position are
    passed over. A start with a later snapshot keeps the first one's position, and its
    rows if they were written, so nothing between the two is lost. A source that the
    configuration doesn't name yet has no table for its rows, so its snapshot is left."""
    session = job_session(spark)
    changes, _ = parse_changes(read_values(session, log, streaming=True))

    def write(batch: DataFrame, batch_id: int) -> None:
        current = current_config(read_layer(session, config, S.CONFIG_ENVELOPE)) if isinstance(config, str) else config()
        newest = newest_per_key(dimension_changes(batch, current)).persist()
        try:
            touched = newest.select("sink_table").distinct()
            for row in current.join(touched, "sink_table").select("sink_table", "sink_columns").distinct().collect():  # a few tables
                mine = newest.where(F.col("sink_table") == row["sink_table"])
                table = dimension_table(session, f"{tables}/{row['sink_table']}", column_names(row["sink_columns"]))
                table.append(dimension_rows(mine, row["sink_columns"]), batch_id)
                table.compact()
        finally:
            newest.unpersist()

    fences = {}
    if snapshots:
        configured = current_config(read_layer(session, config, S.CONFIG_ENVELOPE)) if isinstance(config, str) else config()
        named = {r["source_table"] for r in configured.select("source_table").collect()}  # a few tables
        for source in snapshots.keys() & named:
            rows, position = snapshots[source]
            fences[source] = kept_fence(session, f"{tables}/_fences/{source}", position)
            write(snapshot_changes(rows, source, fences[source]), 0)  # a batch of no stream
    return _start(after_fences(changes, fences), write, checkpoint, available_now)


def fact_job(
    spark: SparkSession,
    log: str,
    layer: str,
    checkpoint: str,
    mode: str = "complete",
    available_now: bool = False,
    files_per_batch: int | None = None,
    early_ttl_ms: int | None = STASH_TTL_MS,
    keep_ttl_ms: int | None = KEEP_TTL_MS,
) -> StreamingQuery:
    """Application changes to the six fact tables under ``layer``, by the state machine
    of ``mode``, in which early credit rows wait for ``early_ttl_ms`` each."""
    session = job_session(spark)
    changes, _ = parse_changes(_spread(read_values(session, log, streaming=True, files_per_batch=files_per_batch), files_per_batch))
    facts = application_facts(fact_changes(changes), mode, _expiry(APPLICATION_CELLS, available_now, early_ttl_ms, keep_ttl_ms))
    return _start(facts, fan_out(APPLICATION_FACTS, layer), checkpoint, available_now)


def joined_fact_jobs(
    spark: SparkSession, log: str, layer: str, checkpoint: str, available_now: bool = False, files_per_batch: int | None = None, patience: str | None = PATIENCE, keep_ttl_ms: int | None = KEEP_TTL_MS, only: tuple[str, ...] = JOINED_JOBS
) -> list[StreamingQuery]:
    """The six fact tables under ``layer`` by the complete rules, in three chained
    jobs: ends of applications with their officers, batch by batch; their
    approvals with replies; steps of credits with approvals. The last two are joins of
    streams that wait for ``patience`` of event time. Bounded runs wait for ever, run one
    after the other, and pair each batch with the layer instead of a state; a job's
    checkpoint is of the one kind or the other. ``only``: the jobs to start; each reads
    what those before it write."""
    session = job_session(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    started = []

    def run(name: str, facts: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> None:
        if name not in only:
            return
        values = about(read_values(session, log, streaming=True, files_per_batch=files_per_batch), JOINED_TABLES[name])
        changes = fact_changes(parse_changes(_spread(values, files_per_batch))[0])
        started.append(_start(facts(changes), write, f"{checkpoint}/{name}", available_now))
        if available_now:
            started[-1].awaitTermination()

    def stream(kind: str) -> DataFrame:
        fs, at = file_system(session, f"{layer}/{kind}")
        fs.mkdirs(at)  # its job may not have written yet
        return session.readStream.schema(PAYLOAD).parquet(f"{layer}/{kind}")

    ttl = None if available_now else keep_ttl_ms
    run("ends", lambda changes: changes, _write_ends(session, layer, f"{checkpoint}/officers", ttl, parts))
    if available_now:
        met = _write_met(session, layer, f"{checkpoint}/unmet", (EARLY_REPLY, EARLY_APPROVAL), ("audit_approve",), approval_sides_before, approvals_met, parts)
        run("approvals", lambda changes: approval_sides(stream(APPROVED), changes), met)
        before = lambda early, approved, *made: credit_sides_before(early, approved, dict(zip(CREDIT_FACTS, made, strict=True)))
        met = _write_met(session, layer, f"{checkpoint}/unmet", (EARLY_CREDIT,), CREDIT_FACTS, before, credits_met, parts, ("audit_approve",))
        run("credits", lambda changes: credit_sides(stream("audit_approve"), changes), met)
    else:
        run("approvals", lambda changes: approvals(stream(APPROVED), changes, patience), fan_out(("audit_approve",), layer))
        run("credits", lambda changes: credit_steps(stream("audit_approve"), changes, patience), fan_out(CREDIT_FACTS, layer))
    return started


def _spread(values: DataFrame, files_per_batch: int | None) -> DataFrame:
    """A file is one task's: the messages of few files are dealt out and parsed by all."""
    spark = values.sparkSession
    if not files_per_batch or files_per_batch >= spark.sparkContext.defaultParallelism:
        return values
    return values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value")


def _planned(spark: SparkSession, parts: str):
    """A batch's own shuffles: as many partitions as the caller's session has, since no
    state is bound to their number, or fewer if the rows are few."""
    return with_conf(spark, {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": parts} | NO_LEFTOVERS)


def _write_met(
    session: SparkSession,
    layer: str,
    unmet: str,
    waits: tuple[str, ...],
    kinds: tuple[str, ...],
    before: Callable[..., DataFrame],
    outcome: Callable[[DataFrame], DataFrame],
    parts: str,
    more: tuple[str, ...] = (),
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's sides and those from ``before`` (of what waits since
    the last batch, ``more`` layers, and the facts made so far) to the facts ``kinds`` of
    ``layer`` and to what waits now, in the folder ``unmet``. The first batch of a job
    has nothing before it."""
    out = fan_out(kinds, layer, {k: f"{unmet}/{k}" for k in waits})

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            last = batch_name(session, batch_id - 1)
            held = [spark.read.schema(PAYLOAD).parquet(f"{unmet}/{k}/batch={last}") for k in waits]
            batch = batch.unionByName(before(*held, *[read_layer(spark, f"{layer}/{k}", PAYLOAD) for k in (*more, *kinds)]))
        with _planned(spark, parts):
            out(outcome(batch), batch_id)
        for k in waits:  # the last batch's stays until this one's is surely used
            drop_path(session, f"{unmet}/{k}/batch={batch_name(session, batch_id - 2)}")

    return write


def _write_ends(session: SparkSession, layer: str, officers: str, ttl_ms: int | None, parts: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ends of applications to ``layer``, and the officers that wait
    for one to a table in ``officers``. Its changes are kept by batch until the table
    has them, so a batch that runs again finds the officers as it found them before."""
    out = fan_out((APPROVED, "audit_cancel", "audit_reject"), layer, {OFFICER: f"{officers}/changes"})

    def write(batch: DataFrame, batch_id: int) -> None:
        table = LogTable(batch.sparkSession, f"{officers}/table", WAITING, ["id"], hash_part("id"))
        with _planned(batch.sparkSession, parts):
            out(application_ends(batch, table.read(), int(time.time() * 1000), ttl_ms), batch_id)
        made = batch.sparkSession.read.schema(PAYLOAD).parquet(f"{officers}/changes/batch={batch_name(session, batch_id)}")
        changes = made.select(F.inline(F.array(F.from_json("payload", f"{WAITING}, deleted boolean"))))
        if not changes.isEmpty():
            table.append(changes, batch_id)
            table.compact()
        fs, before = file_system(session, f"{officers}/changes/batch={batch_name(session, batch_id - 1)}")
        fs.delete(before, True)

    return write


def contract_job(spark: SparkSession, log: str, layer: str, checkpoint: str, available_now: bool = False, early_ttl_ms: int | None = None, keep_ttl_ms: int | None = KEEP_TTL_MS) -> StreamingQuery:
    """Contract changes and produced contracts of ``layer`` to the lease facts."""
    session = job_session(spark)
    changes, _ = parse_changes(about(read_values(session, log, streaming=True), CONTRACT_TABLES))
    produced = session.readStream.schema(PAYLOAD).parquet(f"{layer}/contract_produced")
    facts = contract_facts(fact_changes(changes), produced.select("payload"), _expiry(CONTRACT_CELLS, available_now, early_ttl_ms, keep_ttl_ms))
    return _start(facts, fan_out(CONTRACT_FACTS, layer), checkpoint, available_now)


def fact_stream(spark: SparkSession, layer: str, fact: str, time: str) -> DataFrame:
    """A fact table as a stream of typed rows with its event time parsed."""
    rows = spark.readStream.schema(PAYLOAD).parquet(f"{layer}/{fact}")
    return typed_facts(rows, fact).withColumn(time, event_time(F.col(time)))


def summary_job(
    spark: SparkSession,
    name: str,
    layer: str,
    target: str,
    checkpoint: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = False,
    keep_days: int | None = None,
) -> StreamingQuery:
    """One summary of ``SUMMARIES`` from its fact table to a table by day, closed
    windows replacing rows of the same key; ``read_summary`` reads it. A batch is
    appended, and days with many changes are compacted. ``enrich`` gets each batch, so
    dimensions it reads are those of that moment. ``keep_days``: older days go."""
    spec, session = SUMMARIES[name], job_session(spark)
    summary = summarize(fact_stream(session, layer, spec.fact, spec.time), name, streaming=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = enrich(batch) if enrich else batch
        table = day_table(session, target, ddl(rows), summary_keys(name))
        table.append(rows, batch_id)
        table.compact(least=2)  # a batch has one row a key
        if keep_days is not None:
            today = session.range(1).select(F.current_date().cast("string")).first()[0]
            drop_old_days(table, today, keep_days)

    return _start(summary, write, checkpoint, available_now)


def rollup_job(spark: SparkSession, layer: str, target: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame], available_now: bool = False) -> StreamingQuery:
    """Audited sums by day and top industry, top department and direction to the table
    ``target``: each day once, after it is closed (``rolled_up_days``)."""
    name = "ind_org_salesman_approval"
    spec = SUMMARIES[name]
    days = rolled_up_days(fact_stream(job_session(spark), layer, spec.fact, spec.time), name, enrich)
    return _start(days, lambda batch, batch_id: append_batch(batch, target, batch_id), checkpoint, available_now)


def summary_keys(name: str) -> list[str]:
    return ["cur_date", "stt", "edt", *SUMMARIES[name].keys]


def read_summary(spark: SparkSession, name: str, target: str, schema: str) -> DataFrame:
    return day_table(spark, target, schema, summary_keys(name)).read()


def quarantine_job(spark: SparkSession, log: str, layer: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The messages of a log that no job can use, with the reason, each once, to the
    table ``layer``; its rows' batch is in the folder's name."""
    bad = parse_changes(read_values(job_session(spark), log, streaming=True))[1]
    return _start(bad, lambda batch, batch_id: append_batch(batch, layer, batch_id), checkpoint, available_now)


def count_job(spark: SparkSession, log: str, target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The running count of a log's messages, the newest count in ``target``."""
    rows = read_values(job_session(spark), log, streaming=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(target)

    return _start(rows.groupBy().count(), write, checkpoint, available_now, "complete")


def facts_of(spark: SparkSession, layer: str, kind: str) -> DataFrame:
    return typed_facts(read_layer(spark, f"{layer}/{kind}", PAYLOAD), kind)
