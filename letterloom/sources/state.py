"""What was read of a folder tree, and what has changed since: a table of files with size, time, digest and letters.

Listing reads names, sizes and times, never content. Files whose size or time is another one are read for their digest; those with the same digest only get
their new time written down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "source_file string, length bigint, modified timestamp, digest string, letters array<string>, n_review bigint"
KEPT = 2


def difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """``source_file, status, digest`` (the earlier one): ``added``, ``gone``, ``same``, or ``suspect`` where size or time differ."""
    a, b = now.select("source_file", "length", "modified", F.lit(True).alias("_a")), before.select("source_file", F.col("length").alias("_length"), F.col("modified").alias("_modified"), "digest", F.lit(True).alias("_b"))
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "gone").when(same, "same").otherwise("suspect")
    return a.join(b, "source_file", "full").select("source_file", status.alias("status"), "digest")


def settled(found: DataFrame, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """:func:`difference` with each suspect told apart by its content: ``changed``, or ``touched`` where the digest is the earlier one.

    ``read(names)`` gives ``source_file, content`` of some files; it is not called without suspects.
    """
    names = [r.source_file for r in found.where("status = 'suspect'").select("source_file").collect()]
    if not names:
        return found
    digest = read(names).select("source_file", F.sha2("content", 256).alias("_digest"))
    return found.join(digest, "source_file", "left").select(
        "source_file", F.when(F.col("status") != "suspect", F.col("status")).when(F.col("digest").eqNullSafe(F.col("_digest")), "touched").otherwise("changed").alias("status"), "digest"
    )


class FileState:
    """Tables ``root/f<n>``; the newest that was written whole counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted((int(n[1:]) for n in names if n[:1] == "f" and n[1:].isdigit()), reverse=True)

    def read(self) -> DataFrame | None:
        for n in self._numbers():
            if self._fs.exists(self._path(f"{self.root}/f{n}/_SUCCESS")):
                return self.spark.read.schema(FILES).parquet(f"{self.root}/f{n}")
        return None

    def write(self, state: DataFrame) -> None:
        number = max(self._numbers(), default=-1) + 1
        state.select(*[c.split(" ")[0] for c in FILES.split(", ")]).write.parquet(f"{self.root}/f{number}")
        for n in self._numbers()[KEPT:]:
            self._fs.delete(self._path(f"{self.root}/f{n}"), True)
