"""Brings this package to the tasks' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_kairograph", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="kairograph-"), "kairograph.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(at)  # the driver serves it
    context._kairograph = True
