"""Sort-means against rounds in full, by brute force and in SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterloom.llm import centroids


def brute(rows, k=8, rounds=10, dim=64):
    """Python's own whole numbers, every distance."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(1024 * x) < 1 << 27 for x in v)]
    key = lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(c)]
    return [(i, j, d) for (i, v) in kept for d, j in [near(v)]], c


def vectors(spark, rows, kind="double", parts=3):
    return spark.createDataFrame(spark.sparkContext.parallelize([(i, v, 7, 1) for i, v in rows], parts), f"vec_id long, embedding array<{kind}>, cluster int, block long")


@pytest.mark.parametrize("size", [5, 4096])
def test_odd_rows(spark, tmp_path, size):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.1, 0.2, 0.7]) * rnd.choice([1, 1, 40]) for _ in range(4)]) for i in range(60)]
    rows += [(5, rows[5][1])] * 7 + [(100 + i, rows[8][1]) for i in range(9)]  # repeated rows, and ties between copies
    rows += [(None, [9.0] * 4), (None, None), (200, []), (201, [1.0, None, 1.0, 1.0]), (202, [math.nan] * 4), (203, [math.inf, 0.0, 0.0, 0.0]), (204, [1.0] * 5), (205, [1e300] * 4), (206, [-1e-9, 0.0, 0.0, -0.0])]
    for k in (1, 3, 8, 100):
        kept = centroids.whole(vectors(spark, rows), dim=4)
        start = centroids.first_by(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256), kept, k)
        got, ends, inertia = centroids.sort_means(kept, start, 10, 4, size)
        want, c = brute(rows, k, dim=4)
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert ends == c and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        assert sum(inertia) == sum(d for _, _, d in want) and inertia == [sum(d for _, j, d in want if j == n) for n in range(len(c))]
    folder = str(tmp_path / "none")
    vectors(spark, rows).limit(0).write.parquet(f"{folder}/embeddings.parquet")
    assert centroids.op13_centroids(spark, folder).count() == 0


def test_sort_means_skips_distances_and_stays_exact():
    rng = np.random.default_rng(3)
    c = rng.integers(-1000, 1000, (40, 16))
    x = c[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 16))
    every = ((x[:, None, :] - c[None]) ** 2).sum(2)
    labels, best, measured = centroids.nearest(x, c, every.argmin(1).astype(np.uint8))
    assert (labels == every.argmin(1)).all() and (best == every.min(1)).all() and measured < 0.2 * every.size
    labels, best, _ = centroids.nearest(x, c, rng.integers(0, 40, 5000).astype(np.uint8))
    assert (labels == every.argmin(1)).all() and (best == every.min(1)).all()
    twice = np.concatenate([c, c])  # ties: the smaller number
    assert (centroids.nearest(x, twice, np.full(5000, 79, np.uint8))[0] == every.argmin(1)).all()


def test_blocks_are_not_shuffled_again(spark):
    kept = centroids.whole(vectors(spark, [(i, [float(i)] * 4) for i in range(50)]), dim=4)
    centroids.checkpoints(spark)
    held = centroids.blocks(kept, 4, 5)
    state = held.selectExpr("block", "ids AS labels").mapInArrow(lambda b: b, "block long, labels binary")
    joined = held.select("block", "vectors").groupBy("block").cogroup(state.groupBy("block")).applyInArrow(lambda a, b: a, "block long, vectors binary")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
