"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """``table``, just read from files, dealt out over as many partitions as the cluster has cores, if files and row groups give fewer.

    What is costly for each row then uses all cores; larger inputs, which have enough partitions, are left as they are, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
