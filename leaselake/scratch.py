"""Paths for intermediate files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Shuffled rows go when the work that read them is done; else they stay on disk until the
#: driver collects its garbage.
NO_LEFTOVERS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_LOCAL_DEFAULT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is configured and
    driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_DEFAULT:
        _LOCAL_DEFAULT.append(tempfile.mkdtemp(prefix="leaselake-shared-"))
    return "file://" + _LOCAL_DEFAULT[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, hadoop_path = file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate folder that nothing reads again."""
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)


@contextmanager
def with_conf(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of a session for the work within."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``."""
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop_path
