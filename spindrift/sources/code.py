"""The package's own code on the executors, whose Python may not have it on its path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends the package once to the workers of this application, as Spark sends files: from the driver, by its own server."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}-code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
