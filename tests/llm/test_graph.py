"""Components of long paths: few rounds, and plans that do not grow with them."""

import random

from pyspark.sql import DataFrame

from letterloom.llm import graph


def test_long_paths_take_few_rounds_and_small_plans(spark, monkeypatch):
    names = random.Random(3).sample(range(10_000), 300)
    edges = [(names[i], names[i + 1]) for i in range(299) if i != 200] + [(7 + 10_000, 5 + 10_000), (9, 9)]
    table, sizes = spark.createDataFrame(edges, "a long, b long"), []
    kept = type(table).checkpoint

    def checkpoint(self: DataFrame, *args) -> DataFrame:
        out = kept(self, *args)
        sizes.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length())
        assert len(sizes) <= 45, "too many rounds"
        return out

    monkeypatch.setattr(type(table), "checkpoint", checkpoint)
    got = {r.node: r.label for r in graph.components(table).collect()}
    first, second = names[:201], names[201:]
    assert got == dict.fromkeys(first, min(first)) | dict.fromkeys(second, min(second)) | dict.fromkeys((10_005, 10_007), 10_005)
    assert max(sizes) < 512  # digits of the size that the optimizer estimates
