"""Sends this package to the executors, as ``--py-files`` would."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: Python workers may not have the driver's path."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = Path(__file__).parent
    # for workers beside the driver, which streaming state operators start
    paths = [str(package.parent), sc.environment.get("PYTHONPATH", "")]
    sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in paths if x)
    archive = Path(tempfile.mkdtemp(prefix="leaselake-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SENT.add(sc.applicationId)
