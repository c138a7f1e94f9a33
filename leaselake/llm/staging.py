"""Written intermediate tables in the folder that all executors share.

``stage`` cuts lineage the durable way: a Parquet table under
``spark.checkpoint.dir``, so a lost executor costs a re-read and not a
recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from leaselake.scratch import file_system, new_path

__all__ = ["drop_staged", "new_path", "stage"]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame | None) -> None:
    """Delete a table written by ``stage`` once nothing reads it any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        fs, hadoop_path = file_system(df.sparkSession, path)
        fs.delete(hadoop_path, True)
