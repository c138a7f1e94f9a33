"""Sinks: exactly-once layers, text files, console. Keyed tables are in ``tables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaselake.scratch import file_system
from leaselake.streaming.tables import stream_id


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def batch_name(spark: SparkSession, batch_id: int) -> str:
    return f"{stream_id(spark)}_{batch_id}".lstrip("_")


def has_batch(spark: SparkSession, path: str, batch_id: int) -> bool:
    return exists(spark, f"{path}/batch={batch_name(spark, batch_id)}")


def append_batch(df: DataFrame, path: str, batch_id: int, **options: str) -> None:
    """Append once: a batch owns its folder, which appears whole (written under a
    hidden name, then renamed) and is never written again. So a batch that runs a
    second time changes nothing, for batch readers and for streams that follow. The
    file system must rename folders atomically, which object stores do not."""
    spark = df.sparkSession
    name = batch_name(spark, batch_id)
    fs, at = file_system(spark, f"{path}/batch={name}")
    if fs.exists(at):
        return
    df.write.mode("overwrite").options(**options).parquet(f"{path}/_{name}")
    _, hidden = file_system(spark, f"{path}/_{name}")
    if not fs.rename(hidden, at) and not fs.exists(at):
        raise OSError(f"{at} could not be put in place")


def kept_fence(spark: SparkSession, path: str, fence: tuple[int, ...]) -> tuple[int, ...]:
    """The fence that was first written to ``path``: this one, or that of an earlier
    start. A later snapshot doesn't move it, since what the log holds between the two
    may not be applied yet."""
    columns = [f"f{n}" for n in range(len(fence))]
    append_batch(spark.createDataFrame([tuple(fence)], ", ".join(f"{c} long" for c in columns)), path, 0)
    return tuple(read_layer(spark, path).select(*columns).first())


def read_layer(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("basePath", path).parquet(path).drop("batch")


def fan_out(kinds: tuple[str, ...], path: str, elsewhere: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: tagged rows to one layer table per kind, as ``append_batch``
    does for one. The batch is written once, split by its kinds under a hidden name, so
    the work before it is done once and nothing is cached; a batch that died after that
    is completed from there, so all its kinds come from one run. ``elsewhere``: more
    kinds, by the folder that each goes to."""
    folders = {k: f"{path}/{k}" for k in kinds} | (elsewhere or {})

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = batch_name(spark, batch_id)
        hidden = f"{path}/_{name}"
        missing = [k for k, folder in folders.items() if not exists(spark, f"{folder}/batch={name}")]
        if not missing:
            return
        if not exists(spark, f"{hidden}/_SUCCESS"):
            mine = batch.where(F.col("kind").isin(*missing)).withColumn("_kind", F.col("kind"))
            mine.write.mode("overwrite").option("compression", "zstd").partitionBy("_kind").parquet(hidden)
        for kind in missing:
            fs, made = file_system(spark, f"{hidden}/_kind={kind}")
            _, at = file_system(spark, f"{folders[kind]}/batch={name}")
            fs.mkdirs(made)  # a batch without a row of the kind has a folder too
            fs.mkdirs(at.getParent())
            if not fs.rename(made, at) and not fs.exists(at):
                raise OSError(f"{at} could not be put in place")
        fs.delete(file_system(spark, hidden)[1], True)

    return write


def text_files(df: DataFrame, path: str, checkpoint: str, every: str = "15 minutes", rows_per_file: int = 1_000_000) -> StreamingQuery:
    """A stream's ``value`` column to rolling text files."""
    writer = df.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file)
    return writer.trigger(processingTime=every).start()


def console(df: DataFrame, mode: str = "append") -> StreamingQuery:
    """A stream's rows on the driver's console, for a look at a job under work."""
    return df.writeStream.format("console").outputMode(mode).start()
