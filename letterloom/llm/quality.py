"""Quality by histogram gradient-boosted trees over document statistics.

Method. Each whole text gives a row of statistics (:data:`STATISTICS`): sizes, shares of kinds of signs over all of it and in its worst stretch of
``STRETCH`` bytes, repetition of words and lines. The labelled rows' statistics are cut into at most ``BINS`` bins by their quantiles. Trees are grown level by
level on sums of gradients and curvatures of the logistic loss for each bin, each tree on what those before leave over. A tree is a complete binary tree of
``DEPTH`` levels whose nodes stand in arrays, so that a batch of documents descends all trees at once by numpy indexing.

Bounds: at most ``SAMPLE`` labelled documents teach (the smallest hashes of their ids); the driver sees their statistics, never their texts. Scoring reads
each whole text once, in its scan task, and needs no shuffle.

Rows: every input row gives one row; null and empty texts have statistics of zero and are scored like others; if a ``doc_id`` has several labels the least
counts; null labels and ids don't teach; without labels of both kinds all scores are the one label's share (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._packs import arrow_limits

SAMPLE = 20_000
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
#: Added to curvatures, so that leaves of few rows say little.
RIDGE = 1.0
#: Least curvature of a leaf.
LEAST = 2.0
STRETCH = 512
UPPER, LOWER, DIGIT, SPACE, STOP, MARK, BAR, SIGN, HIGH, OTHER = range(10)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[65:91], KINDS[97:123], KINDS[48:58], KINDS[128:] = UPPER, LOWER, DIGIT, HIGH
KINDS[[0x20, *range(9, 14)]] = SPACE
KINDS[[ord(c) for c in ".,;:'\"-"]] = STOP
KINDS[[ord(c) for c in "!?"]] = MARK
KINDS[[ord(c) for c in "|<>{}[]/\\=_~^"]] = BAR
KINDS[[ord(c) for c in "#$%&*@+"]] = SIGN
STATISTICS = [
    "bytes", "words", "lines", "word_length", "line_length", *(f"share_{k}" for k in ("upper", "lower", "digit", "space", "stop", "mark", "bar", "sign", "high")),
    *(f"worst_{k}" for k in ("upper", "digit", "mark", "bar", "sign")), "entropy", "distinct_words", "distinct_lines", "commonest_word", "repeated_word", "longest_repeat", "worst_repeat", "ends_in_stop", "long_word",
]


def statistics(text: str | None) -> list[float]:
    """The row of :data:`STATISTICS` of one text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    kind = KINDS[np.frombuffer(raw, np.uint8)]
    n, lines, words = len(raw), raw.split(b"\n"), raw.split()
    count = np.bincount(kind, minlength=10)
    share = count / n
    starts = np.arange(0, n, STRETCH)
    size = np.diff(np.r_[starts, n])
    full = size >= min(n, STRETCH // 2)  # a short rest at the end says nothing
    worst = [float((np.add.reduceat((kind == k).astype(np.int32), starts) / size)[full].max()) for k in (UPPER, DIGIT, MARK, BAR, SIGN)]
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    each = each[each > 0]
    m = max(len(words), 1)
    held: dict[bytes, int] = {}
    for w in words:
        held[w] = held.get(w, 0) + 1
    same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, max(len(words) - 1, 0))
    edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
    longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
    many = np.add.reduceat(same.astype(np.int32), np.arange(0, len(same), 64)) if len(same) else np.zeros(1, np.int32)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), (n - count[SPACE]) / m, n / len(lines), *share[:9].tolist(), *worst, float(-(each * np.log2(each)).sum()),
        len(held) / math.sqrt(m), len(set(lines)) / len(lines), max(held.values(), default=0) / m, float(same.sum()) / m, math.log1p(longest), float(many.max()) / min(64, max(len(same), 1)),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), max(map(len, words), default=0) / 64,
    ]


@dataclass
class Trees:
    """Complete binary trees in arrays: node i of a tree has the children 2i + 1 (at most the threshold) and 2i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows of statistics."""
        at, tree = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(self.feature))
        row = np.arange(len(x))[:, None]
        for _ in range(int(math.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - self.feature.shape[1]].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sums ``(nodes, features, bins)``: each node's gain, feature and last bin of its left side; a gain of 0 where nothing is gained (ties: the first)."""
    left_g, left_h = g.cumsum(2), h.cumsum(2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(left_h < LEAST) | (right_h < LEAST)] = 0
    flat = gain.reshape(len(g), -1)
    where = flat.argmax(1)
    return np.maximum(flat[np.arange(len(g)), where], 0), where // g.shape[2], where % g.shape[2]


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for rows of statistics and labels 0 or 1."""
    share = float(y.mean()) if len(y) else 0.5
    inner, none = (1 << depth) - 1, share in (0.0, 1.0) or not len(y)
    base = math.log((share + 1e-9) / (1 - share + 1e-9))
    if none:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1], method="lower")) for c in x.T]
    bins = np.column_stack([np.searchsorted(cut, c) for cut, c in zip(cuts, x.T, strict=True)])
    raw, out = np.full(len(y), base), ([], [], [])
    width = x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            n = 1 << level
            sums = [np.stack([np.bincount(node * BINS + bins[:, f], v, n * BINS).reshape(n, BINS) for f in range(width)], 1) for v in (g, h)]
            gain, f, b = best_split(*sums)
            split = np.flatnonzero(gain > 1e-9)
            at = n - 1 + split
            feature[at], threshold[at] = f[split], [cuts[i][j] for i, j in zip(f[split].tolist(), b[split].tolist(), strict=True)]
            right = np.zeros(len(y), bool)
            for k in split.tolist():
                own = node == k
                right[own] = bins[own, f[k]] > b[k]
            node = 2 * node + right
        leaf = RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + RIDGE)
        raw += leaf[node]
        for held, new in zip(out, (feature, threshold, leaf), strict=True):
            held.append(new)
    return Trees(*map(np.array, out), base)


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, sample: int = SAMPLE) -> Trees:
    """``teaches`` tells, from ``doc_id``, which labelled rows may be learnt from."""
    arrow_limits(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(teaches)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "x": pa.array(x, pa.list_(pa.float64())), "y": batch.column(2)})

    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, x array<double>, y int")  # at most ``sample`` rows of 12 bytes are broadcast
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()  # ids can be repeated
    return boosted(np.array([r.x for r in rows], np.float64).reshape(-1, len(STATISTICS)), np.array([r.y for r in rows], np.float64))


def quality(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score``"""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(model.score(x), pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 1)
    return quality(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
