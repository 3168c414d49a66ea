"""Where lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder: the session's ``spark.checkpoint.dir``, or in local mode only, where nothing is set, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="letterloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df``, checkpointed, for loops: Spark takes its size to be unknown.

    A checkpoint keeps the size that the optimizer had estimated, and for a join that is the product of both sides. Where each round joins what the one before
    it left, the number gets twice as many digits with each round, until the driver's memory is full of it.
    """
    spark, held = df.sparkSession, df.checkpoint()
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.toJavaRDD(), held._jdf.schema()), spark)
