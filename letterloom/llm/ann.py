"""Nearest neighbours by score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

Method. Vectors are scaled to length 1, so that largest inner product means largest cosine. A product quantiser with 16 centres for
each pair of dimensions (four bits each) is trained and assigned under the anisotropic loss: of a vector's residual, the part parallel to
the vector counts ``eta`` times the rest, as it is what shifts large inner products. Rows are dealt into shards by a hash of their id;
every shard indexes all its rows. Each query's table of inner products with the centres (two four-bit tables are joined to one
byte-wide table) is summed over the codes of a shard; the ``rerank`` best go to the exact measure in double precision, which gives a
k-th score. By the angle between a row and its code (:func:`least_sum`) it is known how far a sum can be from the row's inner product:
every other row that can still reach the k-th score goes to the exact measure too. The best of all shards are merged. The queries visit
every shard in blocks, since no partitioning keeps recall on vectors without clusters. No neighbour is lost: what codes do not tell
apart costs time.

Bounds: codebooks are fitted on at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``, those with the smallest hashes; they are 16 x d doubles. A shard has
about ``SHARD_BYTES`` of vectors, whatever the table's size and width; the exact measure takes ``RERANK`` rows at once. :func:`build` gives the
index as a table, which can be written and searched again.

Rows: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those whose length is not the most common one
(ties: the smaller); null ids take no part; equal scores go to the smaller id; rows that share an id are all candidates, except for
the queries of that id, each of which gets a list of its own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
SHARD_BYTES = 64 << 20  # as doubles
QUERIES = 256  # of a block in a shard
RERANK = 8192
SCHEMA = "query_id long, query long, vec_id long, score double"
OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def eta(d: int, threshold: float = 0.2) -> float:
    """Weight of the parallel part for inner products above the threshold on the unit sphere."""
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


def assign(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, m) that lower the anisotropic loss, by coordinate descent from the nearest centres."""
    n, (m, k, s) = len(x), books.shape
    parts = x.reshape(n, m, s)
    code, along = np.empty((n, m), np.uint8), np.empty((n, m))
    for j in range(m):
        r = parts[:, j, None, :] - books[j]
        code[:, j] = np.einsum("nks,nks->nk", r, r).argmin(1)
        along[:, j] = np.einsum("ns,ns->n", parts[:, j] - books[j][code[:, j]], parts[:, j])
    total = along.sum(1)
    for _ in range(rounds):
        for j in range(m):
            r = parts[:, j, None, :] - books[j]
            dot = np.einsum("nks,ns->nk", r, parts[:, j])
            rest = total - along[:, j]
            code[:, j] = (np.einsum("nks,nks->nk", r, r) + (weight - 1) * (rest[:, None] + dot) ** 2).argmin(1)
            along[:, j] = dot[np.arange(n), code[:, j]]
            total = rest + along[:, j]
    return code


def train(x: np.ndarray, m: int, weight: float, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (m, 16, d / m). Centres solve the weighted least squares of their own vectors, the other parts held fixed."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    s = d // m
    parts = x.reshape(n, m, s)
    books = np.stack([parts[rng.choice(n, 16, replace=n < 16), j] for j in range(m)])
    for step in range(rounds):
        code = assign(x, books, 1.0 if step < 3 else weight, 1)
        w = 1.0 if step < 3 else weight
        along = np.stack([np.einsum("ns,ns->n", parts[:, j] - books[j][code[:, j]], parts[:, j]) for j in range(m)], 1)
        for j in range(m):
            rest = along.sum(1) - along[:, j]
            for c in range(16):
                v, t = parts[code[:, j] == c, j], rest[code[:, j] == c]
                if len(v):  # minimise sum |v - b|^2 + (w - 1) (t + v.v - v.b)^2
                    a = len(v) * np.eye(s) + (w - 1) * v.T @ v
                    books[j, c] = np.linalg.solve(a, v.sum(0) + (w - 1) * (v * (t + np.einsum("ns,ns->n", v, v))[:, None]).sum(0))
            along[:, j] = np.einsum("ns,ns->n", parts[:, j] - books[j][code[:, j]], parts[:, j])
    return books


def spread(unit: np.ndarray, code: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of each row's code along the row and across it, as lengths; the first may be negative."""
    c = books[np.arange(len(books)), code].reshape(unit.shape)
    along = (c * unit).sum(1)
    return along, np.sqrt(((c - along[:, None] * unit) ** 2).sum(1))


def least_sum(score: float, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """The least inner product of a query with each row's code, if with the row itself it is ``score`` or more (all of length 1 but the codes).

    With the row it is t, with the code then at least ``along t - across sqrt(1 - t^2)``, which is convex in t.
    """
    t = np.clip(-along / np.maximum(np.hypot(along, across), 1e-300), min(score, 1.0), 1.0)
    return along * t - across * np.sqrt(1 - t * t)


def added(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, so that scores are the same in every engine that adds in order."""
    return np.add.accumulate(x, axis=1)[:, -1]


def scan(ids: np.ndarray, x: np.ndarray, code: np.ndarray, books: np.ndarray, along: np.ndarray, across: np.ndarray, qid: np.ndarray, number: np.ndarray, q: np.ndarray, k: int, rerank: int):
    """Top k of one shard for some queries. Rows stand in the order of their ids, so ties go to the smaller one."""
    m, n = code.shape[1], len(ids)
    if m % 2:
        code, books = np.column_stack([code, np.zeros(n, np.uint8)]), np.concatenate([books, np.zeros_like(books[:1])])
    wide = np.ascontiguousarray((code[:, 0::2] | code[:, 1::2] << 4).T)
    norm = np.sqrt(added(x * x))
    for i in range(len(q)):
        length = np.sqrt(added(q[i : i + 1] * q[i])[0])
        table = np.einsum("mks,ms->mk", books[:m], (q[i] / length).reshape(m, -1))
        table = np.concatenate([table, np.zeros((len(books) - m, 16))])
        table = np.round(table * (1 << 20)).astype(np.int64)
        joined = (table[0::2, None, :] + table[1::2, :, None]).reshape(len(wide), 256)
        total = joined[0][wide[0]]
        for row, t in zip(wide[1:], joined[1:], strict=True):
            total += t[row]
        open_ = np.ones(n, bool)
        open_[np.searchsorted(ids, qid[i], "left") : np.searchsorted(ids, qid[i], "right")] = False
        near, best = np.zeros(0, np.int64), np.zeros(0)

        def measure(rows):
            nonlocal near, best
            for a in range(0, len(rows), RERANK):
                r = rows[a : a + RERANK]
                score = added(x[r] * q[i]) / (norm[r] * length)
                near, best = np.r_[near, r], np.r_[best, score]
                top = np.lexsort((ids[near], -best))[:k]
                near, best = near[top], best[top]

        key = (total << 24) - np.arange(n)  # equal sums: the smaller id first; a shard has far fewer than 2**24 rows
        first = np.flatnonzero(open_)
        keep = max(rerank, k)
        first = first[np.argpartition(-key[first], keep)[:keep]] if len(first) > keep else first
        measure(first)
        open_[first] = False
        if open_.any():  # so there are k
            slack = m / 2 + 2  # each table entry is rounded to half a unit; the rest is rounding in double precision
            measure(np.flatnonzero(open_ & (total >= least_sum(best[-1], along, across) * (1 << 20) - slack)))
        yield np.full(len(near), qid[i]), np.full(len(near), number[i]), ids[near], best


@dataclass
class Index:
    """``rows``: ``shard, vec_id, x, code, along, across``, to be written as a table if it is searched more than once; ``books``: the centres."""

    rows: DataFrame
    books: np.ndarray
    shards: int


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda e: e != 0))


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.asarray(pa.concat_arrays(column.chunks).flatten()).reshape(-1, d) if len(column) else np.zeros((0, d))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def build(vectors: DataFrame, threshold: float = 0.2) -> Index | None:
    """The index of all usable rows; None without any."""
    v = usable(vectors)
    sizes = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]
    v = v.where(F.size("x") == d)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))).select("x").toArrow()
    m, weight = d // 2 if d % 2 == 0 else d, eta(d, threshold)
    books = train(unit(matrix(sample.column("x"), d)), m, weight)

    def encode(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            x = unit(matrix(t.column("x"), d))
            code = assign(x, books, weight) if len(x) else np.zeros((0, m), np.uint8)
            along, across = spread(x, code, books)
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(x), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "x": batch.column("x"), "code": coded, "along": pa.array(along), "across": pa.array(across)})

    shards = -(-n * d * 8 // SHARD_BYTES)
    coded = v.mapInArrow(encode, "vec_id long, x array<double>, code binary, along double, across double")
    return Index(coded.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), books, shards)


def search(index: Index, queries: DataFrame, k: int = 5, rerank: int = 128) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``queries`` (``vec_id, embedding``) that are as wide as the index."""
    books, d = index.books, index.books.shape[0] * index.books.shape[2]
    asking = usable(queries).where(F.size("x") == d).select("vec_id", "x", F.monotonically_increasing_id().alias("query"))
    asking = asking.select("*", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return OUT.empty_table()
        left = left.sort_by("vec_id")
        ids, x, along, across = np.asarray(left.column("vec_id")), matrix(left.column("x"), d), np.asarray(left.column("along")), np.asarray(left.column("across"))
        code, found = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1), []
        for i in range(0, right.num_rows, QUERIES):
            block = right.slice(i, QUERIES)
            found += scan(ids, x, code, books, along, across, np.asarray(block.column("vec_id")), np.asarray(block.column("query")), matrix(block.column("x"), d), k, rerank)
        return pa.table([pa.array(np.concatenate(z)) for z in zip(*found, strict=True)], schema=OUT)

    found = index.rows.groupBy("shard").cogroup(asking.groupBy("shard")).applyInArrow(run, SCHEMA)
    # At most k rows of each shard meet for a query: merged with partial aggregation, k kept.
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    top = found.groupBy("query_id", "query").agg(F.slice(pairs, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.v").alias("vec_id"), (-F.col("t.s")).alias("score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 128, threshold: float = 0.2) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    index = build(vectors, threshold)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, vectors.where(F.col("vec_id") % every == 0), k, rerank)


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# All pairs of a query and a row, measured by sums from left to right.
ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), n AS (SELECT vec_id, x, sqrt(list_reduce(list_transform(x, lambda e: e * e), lambda a, b: a + b)) AS n FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY len(x) ORDER BY count(*) DESC, len(x) LIMIT 1)),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_reduce(list_transform(list_zip(r.x, q.x), lambda z: z[1] * z[2]), lambda a, b: a + b) / (r.n * q.n) AS score
  FROM n q JOIN n r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
