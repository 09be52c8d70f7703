"""Sends this package to the executors, which needn't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; needed before functions of this package run in Python workers."""
    context = spark.sparkContext
    if getattr(context, "has_own_package", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context.has_own_package = True
