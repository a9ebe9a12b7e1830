"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import prefforge

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this application's Python workers the package, once: functions travel by name, so workers must find them wherever
    the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(prefforge.__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="prefforge-"), "prefforge.zip")  # the driver's copy, which Spark sends on
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(top)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark
