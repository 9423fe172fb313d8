"""Sending this package to the executors, for classes that Python workers import: data sources and stateful processors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per application; Spark copies the file to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.NamedTemporaryFile(prefix="larkspur-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(f.name)
    sc._larkspur_shipped = True
