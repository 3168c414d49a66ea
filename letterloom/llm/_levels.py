"""Levels of sorted runs on disk: the index that lasts from one batch of documents to the next.

A run is a table of ``bucket, blob``. A batch adds a run of level 0; two runs of one level merge, bucket by bucket, into one of the next, so n batches
leave at most log2(n) + 1 runs. ``STATE-<n>`` names the runs that count; it is put in place last, by a rename to a name that is not taken, so a
writer that dies leaves the state before it. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._prints import new_key

RUN = "bucket int, blob binary"


class Levels:
    def __init__(self, spark: SparkSession, root: str, buckets: int, merge: Callable[[list[bytes]], bytes]):
        """``merge`` makes one blob of several, the older first. ``buckets`` counts for a new index only."""
        self.spark, self.root, self.merge = spark, root.rstrip("/"), merge
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = self._numbers("STATE-")
        self.state = {"buckets": buckets, "batches": 0, "runs": [], "key": new_key()}
        if numbers:
            self.state = json.loads(spark.read.text(f"{self.root}/STATE-{numbers[-1]}").first().value)

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    @property
    def key(self) -> int:
        """What the index hashes under, drawn when it is new."""
        return self.state["key"]

    @property
    def batches(self) -> int:
        return self.state["batches"]

    def _numbers(self, prefix: str) -> list[int]:
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.root}/run-{number}")

    def held(self) -> DataFrame:
        """``bucket, pack, blob`` of all runs; their packs are numbered from -1 downwards, the oldest last."""
        out = self.spark.createDataFrame([], "bucket int, pack long, blob binary")
        for i, (_, number) in enumerate(reversed(self.state["runs"])):
            out = out.unionAll(self._read(number).select("bucket", F.lit(-1 - i).cast("long").alias("pack"), "blob"))
        return out

    def add(self, run: DataFrame) -> None:
        merge, runs, number, level = self.merge, list(self.state["runs"]), max(self._numbers("run-"), default=-1) + 1, 0
        run.select("bucket", "blob").write.parquet(f"{self.root}/run-{number}")

        def merged(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("age").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda x: x[0])
            return pa.table({"bucket": pa.array(table.column("bucket").to_pylist()[:1], pa.int32()), "blob": pa.array([merge([x for _, x in rows])][: len(rows)], pa.binary())})

        while runs and runs[-1][0] == level:
            older = runs.pop()[1]
            both = self._read(older).withColumn("age", F.lit(0)).unionAll(self._read(number).withColumn("age", F.lit(1)))
            number, level = number + 1, level + 1
            both.groupBy("bucket").applyInArrow(merged, RUN).write.parquet(f"{self.root}/run-{number}")
        state = self.state | {"batches": self.batches + 1, "runs": [*runs, [level, number]]}
        staged, named = self._path(f"{self.root}/.state"), self._path(f"{self.root}/STATE-{state['batches']}")
        out = self._fs.create(staged, True)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._fs.rename(staged, named):
            raise OSError(f"cannot set {named.toString()}")
        self.state = state

    def prune(self) -> None:
        """Remove runs that the state does not name; results of earlier batches must have been computed."""
        needed = {number for _, number in self.state["runs"]}
        for number in self._numbers("run-"):
            if number not in needed:
                self._fs.delete(self._path(f"{self.root}/run-{number}"), True)
