"""Change-log sources: readers, envelope parsing and the fact whitelist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake import schemas as S


def require_source(spark: SparkSession, path: str | None = None, table: str | None = None) -> None:
    """Raises before a job starts if its source is not there."""
    if table is not None and not spark.catalog.tableExists(table):
        raise FileNotFoundError(f"no table {table}")
    if path is not None:
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"no source at {path}")


def read_values(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Column ``value``, one message a line; empty messages are skipped. A stream
    starts with the files already there."""
    require_source(spark, path=path)
    if not streaming:
        return with_values(spark.read.text(path))
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_values(reader.text(path))


def read_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = True, starting: str = "earliest") -> DataFrame:
    """The same from a Kafka topic; needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    found = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return with_values(found.load())


def with_values(messages: DataFrame) -> DataFrame:
    value = messages.select(F.col("value").cast("string").alias("value"))
    return value.where(F.length("value") > 0)


def about(values: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """Messages that hold the name of one of ``tables`` as a JSON text: others are not
    worth parsing. What is left may be about another table still."""
    return values.where(reduce(lambda a, b: a | b, [F.col("value").contains(f'"{t}"') for t in tables]))


def parse_changes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, quarantined): parsed envelopes, and the messages that are not JSON
    objects with a table and a type, with the ``reason``; ``quarantine_job`` keeps
    these, and the other jobs pass them over instead of failing."""
    # inlined, so that no filter is moved below the parser and parses once more
    parsed = values.select("value", F.inline(F.array(F.from_json("value", S.ENVELOPE)))).select("value", F.struct(*[f.name for f in S.ENVELOPE]).alias("e"))
    good = F.col("e.table").isNotNull() & F.col("e.type").isNotNull()
    return parsed.where(good).select("e.*"), parsed.where(F.coalesce(~good, F.lit(True))).select("value", _reason().alias("reason"))


def _reason() -> Column:
    broken = F.get_json_object("value", "$").isNull()
    return F.when(broken, "no JSON").when(F.col("e.table").isNull(), "no table").otherwise("no type")


def parse_config(values: DataFrame) -> DataFrame:
    """Configuration changes: ``op`` (r, c, u, d), ``before``, ``after``, ``ts_ms``."""
    return values.select(F.from_json("value", S.CONFIG_ENVELOPE).alias("e")).where(F.col("e.op").isNotNull()).select("e.*")


def current_config(changes: DataFrame) -> DataFrame:
    """Newest configuration of each source table; a table whose last change is a
    delete has none."""
    source = F.coalesce("after.source_table", "before.source_table")
    newest = changes.groupBy(source.alias("source_table")).agg(F.max_by(F.struct("op", "after"), F.struct("ts_ms", (F.col("op") != "d").alias("_live"))).alias("e"))
    return newest.where((F.col("e.op") != "d") & F.col("e.after").isNotNull()).select("e.after.*")


def read_config_table(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    """The configuration table by JDBC, columns by name: the snapshot of ``config_job``."""
    return spark.read.jdbc(url, table, properties=properties).select(*S.TABLE_PROCESS.fieldNames())


def read_snapshot(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, properties: dict[str, str]) -> DataFrame:
    """A source table by JDBC in ``parts`` ranges of its numeric ``key`` between
    ``bounds``, read side by side; keys outside of the bounds are in the outer parts."""
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)


def config_snapshot(rows: DataFrame, ts_ms: int) -> DataFrame:
    """Configuration rows as the changes that read them, at ``ts_ms``."""
    nothing = F.lit(None).cast(S.TABLE_PROCESS)
    return rows.select(F.lit("r").alias("op"), nothing.alias("before"), F.struct(*S.TABLE_PROCESS.fieldNames()).alias("after"), F.lit(ts_ms).cast("long").alias("ts_ms"))


def snapshot_changes(rows: DataFrame, table: str, fence: tuple[int, ...]) -> DataFrame:
    """A source table's rows as changes at the ``fence``, the position in the log up
    to which the rows hold every change. Cells are texts, nulls stay null."""
    data = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))])
    cells = {"table": F.lit(table), "type": F.lit("bootstrap-insert"), "data": data} | {c: F.lit(x) for c, x in zip(S.POSITION, fence, strict=True)}
    return rows.select([cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.ENVELOPE])


def after_fences(changes: DataFrame, fences: dict[str, tuple[int, ...]]) -> DataFrame:
    """Changes that no snapshot holds: those beyond their table's fence, those of
    tables without one, and those without a time, whose position is not known."""
    position = F.struct(*S.POSITION)
    held = [(F.col("table") == t) & F.col("ts").isNotNull() & (position <= F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(S.POSITION, fence, strict=True)])) for t, fence in fences.items()]
    return changes.where(~F.coalesce(reduce(lambda a, b: a | b, held), F.lit(False))) if held else changes


def fact_changes(changes: DataFrame) -> DataFrame:
    """Changes of the fact tables whose key is there; all others are dropped."""
    rules = [(F.col("table") == t) & F.col("data")[k].isNotNull() for t, k in S.FACT_KEYS.items()]
    return changes.where(reduce(lambda a, b: a | b, rules))


def split_contracts(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes of applications, changes of contracts)."""
    return changes.where(F.col("table") != "contract"), changes.where(F.col("table") == "contract")
