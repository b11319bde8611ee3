"""Sends this package to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make ``melospark`` importable in the Python workers; done once for an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "melospark.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(home):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("melospark", os.path.relpath(full, home)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
