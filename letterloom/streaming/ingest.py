"""New files into the store as they arrive. An addition: the engine it follows has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_lines, text_lines
from ..operators.store import Store
from ..plans.ingest import finish, store_batch


def text_file_stream(spark: SparkSession, root: str) -> DataFrame:
    """Text files under ``root``, each once, as ``source_file`` and ``lines``; the schema is explicit since streams need one."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = files.where(F.lower("path").endswith(".txt"))
    return files.select(F.substring("path", len(base) + 2, 1 << 20).alias("source_file"), text_lines(F.decode("content", "UTF-8")).alias("lines"))


def stream_into(store: Store, files: DataFrame, checkpoint: str):
    """Upsert every micro-batch. An upsert is idempotent, so a batch that runs twice leaves the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        cut = batch.select("source_file", F.lit(0).alias("segment_index"), clean_lines("lines").alias("lines"), F.lit(1.0).alias("min_line_plausibility"))
        store.upsert(store_batch(finish(cut)))

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
