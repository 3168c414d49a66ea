"""Sends the package to the executors, which may have neither it nor the driver's folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each context; Spark serves the file to executors, also to those that start later."""
    context = spark.sparkContext
    if getattr(context, "_letterloom", False):
        return
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="letterloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/letterloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(f"{folder}/letterloom.zip")
    context._letterloom = True
