"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

TOP = os.path.dirname(os.path.abspath(__file__))
NAME = f"{os.path.basename(TOP)}_package.zip"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once in a session, so that Python workers import it wherever the driver was started."""
    context = spark.sparkContext
    if any(str(p).endswith(NAME) for p in context._python_includes):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), NAME)  # the driver's; Spark copies it to the executors
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(TOP):
            out.write(folder, os.path.relpath(folder, os.path.dirname(TOP)) + "/")  # a package without __init__.py is found by its folder
            for f in files:
                if f.endswith(".py"):
                    out.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(TOP)))
    context.addPyFile(path)
