"""Boosted trees against brute force, and the query on held-out labels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from letterloom.llm import quality
from tests.test_queries import SF


def descend(trees, row):
    """One document, one tree at a time, from node to node."""
    total = trees.base
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        i = 0
        while i < len(f):
            i = 2 * i + (2 if row[f[i]] > t[i] else 1)
        total += leaf[i - len(f)]
    return total


def sample(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 1)
    return x, ((x[:, 0] > 0.2) ^ (x[:, 3] > 0.5)).astype(float)


def test_traversal_like_brute_force():
    x, y = sample()
    trees = quality.boosted(x, y, 12, 3)
    assert trees.feature.shape == (12, 7) and trees.leaf.shape == (12, 8)
    assert np.allclose(trees.raw(x), [descend(trees, r) for r in x])
    new, truth = sample(seed=2)
    assert ((trees.score(new) >= 0.5) == truth).mean() > 0.95


def test_first_split_is_the_best_of_all():
    x, y = sample()
    trees = quality.boosted(x, y, 1, 1)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.RIDGE)
    tried = {(f, t): part(x[:, f] <= t) + part(x[:, f] > t) for f in range(5) for t in np.unique(x[:, f]) if quality.LEAST <= h[x[:, f] <= t].sum() <= h.sum() - quality.LEAST}
    f, t = int(trees.feature[0, 0]), trees.threshold[0, 0]
    assert tried[f, t] >= max(tried.values()) * 0.98  # thresholds are quantiles
    left = x[:, f] <= t
    assert np.allclose(trees.leaf[0], [quality.RATE * g[r].sum() / (h[r].sum() + quality.RIDGE) for r in (left, ~left)])


def test_statistics():
    row = dict(zip(quality.STATISTICS, quality.statistics("AB ab ab ab.\nno stop\nno stop"), strict=True))
    assert row["share_upper"] == 2 / 28 and row["repeated_word"] == 1 / 8 and row["longest_repeat"] == np.log1p(1) and row["ends_in_stop"] == 1 / 3 and row["distinct_lines"] == 2 / 3
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATISTICS)
    long = quality.statistics("x " * 400_000 + "!" * 1200 + " y" * 1000)
    assert dict(zip(quality.STATISTICS, long, strict=True))["worst_mark"] > 0.8 and all(np.isfinite(long))
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("\n", " ", "é", "\0", "a" * 513, "\U0001f600" * 300))


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string, score int, x string")


def test_odd_rows(spark):
    rows = [(i, "plain words in a row. " * (i % 7 + 1) if i % 2 else "LOUD!! WORDS!! " * (i % 5 + 1), 1, "x") for i in range(80)] + [(None, None, 1, "x"), (3, "", 1, "x"), (3, "plain words", 1, "x")]
    labels = [(i, i % 2, None) for i in range(80)] + [(None, 0, None), (7, None, None), (9, 5, None), (11, 1, None)]
    kinds = "doc_id long, quality int, text string"
    docs = docs_of(spark, rows)
    every = F.lit(True)
    model = quality.fit(docs, spark.createDataFrame(labels, kinds), every)
    got = quality.quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] >= 0.5) == i % 2 for i in range(80) if i != 3)
    again = quality.fit(docs_of(spark, rows[::-1], 7), spark.createDataFrame(labels[::-1], kinds), every)
    assert (again.leaf == model.leaf).all() and (again.threshold == model.threshold).all()  # whatever the partitions
    least = quality.fit(docs, spark.createDataFrame([*labels, *[(i, 0, None) for i in range(80)]], kinds), every)
    assert {r.score < 0.01 for r in quality.quality(docs, least).collect()} == {True}
    for table, want in (([], 0.5), ([(1, 1, None)], 1.0)):
        model = quality.fit(docs, spark.createDataFrame(table, kinds), every)
        assert {round(r.score, 6) for r in quality.quality(docs, model).collect()} == {want}
    assert quality.quality(docs.limit(0), quality.fit(docs.limit(0), spark.createDataFrame(labels, kinds), every)).count() == 0
    bounded = quality.fit(docs, spark.createDataFrame(labels, kinds), every, sample=1)
    assert len(bounded.leaf) == 0


@pytest.mark.parametrize(("folder", "least"), [(SF.replace("sf0.001", "sf0.01"), 0.9), (SF.replace("sf0.001", "sf0.1"), 0.97)])
def test_held_out(spark, folder, least):
    got = quality.op11_quality(spark, folder).where("held_out").toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    right = got[got.quality == 1].predicted.mean(), 1 - got[got.quality == 0].predicted.mean()
    print(folder, len(got), right)
    assert len(got) > 30 and min(right) >= least, right
