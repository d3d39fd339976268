"""Make this package importable in Python workers, however the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application (a zip of source files, a few hundred kB)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="ranksmith-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as archive:
        for p in sorted(root.rglob("*.py")):
            archive.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
