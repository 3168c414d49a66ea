"""Centroid clustering by sort-means, in whole numbers.

Method. Lloyd's rounds, each of which skips distances by the triangle inequality: for every centroid the others are ordered by their distance from it; a vector
scans them from its previous assignment on and stops where they lie strictly beyond twice its distance from that centroid, as none of these can be as near.
What is skipped can't even tie, so assignments are those of a full search (ties: the smaller number).

Vectors travel once: rows are dealt into blocks of about ``BLOCK`` vectors, one row each, partitioned by block number and checkpointed. A round joins the
blocks with their labels of the round before (one byte or two a vector: only these are shuffled), writes the new labels and each block's sums, and adds
the sums up over all blocks; the driver sees ``k x dim`` numbers. Sums are decimals and means whole numbers (rounded down), so no order of addition matters.

Rows: of :func:`whole` only vectors with exactly ``dim`` components count, none null or not finite; nor do those with a component of 2**27 and more after
scaling, whose distances would not fit 64 bits. Repeated rows are vectors of their own; a null ``vec_id`` is a vector like others but starts no
centroid before others do; with fewer vectors than ``k`` each starts a centroid; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _packs as P
from ._session import checkpoints

#: Vectors in a block: a quarter of a megabyte for each component of eight bytes in 64.
BLOCK = 4096
LIMIT = 1 << 27
STATE = "block long, labels binary, sums binary"


def whole(vectors: DataFrame, column: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: the vectors that count, their components ``floor(scale * x)`` as whole numbers."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where(F.size("x") == dim)
    fits = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LIMIT))
    return x.where(fits).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid and squared distance, from its previous label; and how many distances were measured."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    out, best, measured = labels.astype(np.int64), np.zeros(len(x), np.int64), len(x)
    for a in range(len(centroids)):
        rows = np.flatnonzero(labels == a)
        if not len(rows):
            continue
        own = ((x[rows] - centroids[a]) ** 2).sum(1)
        best[rows] = own
        order = np.lexsort((np.arange(len(centroids)), between[a]))
        left = np.arange(len(rows))
        for j in order[order != a].tolist():
            # d(a, j) > 2 d(x, a), of whole squares.
            left = left[own[left] >= -(-int(between[a, j]) // 4)]
            if not len(left):
                break
            at = rows[left]
            d, measured = ((x[at] - centroids[j]) ** 2).sum(1), measured + len(at)
            closer = (d < best[at]) | (d == best[at]) & (j < out[at])
            best[at[closer]], out[at[closer]] = d[closer], j
    return out, best, measured


def matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32).reshape(-1, dim).astype(np.int64)


def blocks(vectors: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """``block, ids, known, vectors``: the rows in blocks, partitioned by block and checkpointed, so that they are shuffled once."""

    def pack(batches):
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, size - n)
                held, n, batch = [*held, taken], n + taken.num_rows, batch.slice(taken.num_rows)
                if n == size:
                    yield row(part << 32 | seq, held)
                    held, n, seq = [], 0, seq + 1
        if n:
            yield row(part << 32 | seq, held)

    def row(number, held):
        table = pa.Table.from_batches(held).combine_chunks()
        ids, v = table.column("vec_id").combine_chunks(), table.column("v").combine_chunks()
        flat = np.asarray(v.flatten()).astype(np.int32)
        known = np.asarray(ids.is_valid())
        return pa.record_batch({"block": pa.array([number], pa.int64()), "ids": pa.array([np.asarray(ids.fill_null(0)).tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})

    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = P.settled(vectors).mapInArrow(pack, "block long, ids binary, known binary, vectors binary").repartition(parts, "block")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that may be changed keeps no partitioning through a checkpoint
    try:
        return dealt.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def moved(state: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]], list[int]]:
    """How many vectors each label has, the sums of their components, and of their distances: added in the tasks, then over all."""
    width = dim + 2

    def add(batches):
        total: np.ndarray | None = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = np.frombuffer(blob, np.int64).reshape(k, width).astype(object)  # whole numbers of any size
                total = own if total is None else total + own
        if total is not None:
            c, d = np.indices(total.shape)
            yield pa.record_batch({"c": pa.array(c.ravel(), pa.int32()), "d": pa.array(d.ravel(), pa.int32()), "s": pa.array([str(s) for s in total.ravel()], pa.string())})

    sums = state.select("sums").mapInArrow(add, "c int, d int, s string").groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k * (dim + 2) rows
    table = [[0] * width for _ in range(k)]
    for r in sums:
        table[r.c][r.d] = int(r.s)
    return [t[0] for t in table], [t[2:] for t in table], [t[1] for t in table]


def sort_means(vectors: DataFrame, start: list[list[int]], rounds: int, dim: int, size: int = BLOCK) -> tuple[DataFrame, list[list[int]], list[int]]:
    """``vec_id, cluster, distance`` after ``rounds`` rounds from the centroids ``start`` and one more assignment; the centroids; and their sums of distances."""
    checkpoints(vectors.sparkSession)
    k, centroids = len(start), [list(c) for c in start]
    kind = np.uint8 if k <= 256 else np.uint16 if k <= 1 << 16 else np.uint32
    held = blocks(vectors, dim, size)

    def assign(at: np.ndarray):
        def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            out = []
            before = dict(zip(right.column("block").to_pylist(), right.column("labels").to_pylist(), strict=True)) if right is not None else {}
            for block, blob in zip(left.column("block").to_pylist(), left.column("vectors").to_pylist(), strict=True):
                x = matrix(blob, dim)
                labels = np.frombuffer(before[block], kind) if before else np.zeros(len(x), kind)
                labels, best, _ = nearest(x, at, labels)
                sums = np.zeros((k, dim + 2), np.int64)
                sums[:, 0] = np.bincount(labels, minlength=k)
                np.add.at(sums[:, 1], labels, best)
                order = np.argsort(labels, kind="stable")
                heads = np.flatnonzero(np.diff(labels[order], prepend=-1))
                sums[labels[order[heads]], 2:] = np.add.reduceat(x[order], heads, axis=0)
                out.append((block, labels.astype(kind).tobytes(), sums.tobytes()))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.table({"block": pa.array(a, pa.int64()), "labels": pa.array(b, pa.binary()), "sums": pa.array(c, pa.binary())})

        return run

    def step(state: DataFrame | None) -> DataFrame:
        run = assign(np.array(centroids, np.int64).reshape(k, dim))
        if state is None:
            new = held.select("block", "vectors").mapInArrow(lambda batches: (b for x in batches for b in run(pa.Table.from_batches([x])).to_batches()), STATE)
        else:
            new = held.select("block", "vectors").groupBy("block").cogroup(state.select("block", "labels").groupBy("block")).applyInArrow(run, STATE)
        return new.checkpoint()

    state = None
    for _ in range(rounds):
        state = step(state)
        counts, sums, _ = moved(state, k, dim)
        centroids = [[s // n for s in row] if n else old for n, row, old in zip(counts, sums, centroids, strict=True)]
    state = step(state)
    inertia = moved(state, k, dim)[2]
    last = np.array(centroids, np.int64).reshape(k, dim)

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, known, blob, labels in zip(*(left.column(c).to_pylist() for c in ("ids", "known", "vectors")), right.column("labels").to_pylist(), strict=True):
            label = np.frombuffer(labels, kind).astype(np.int32)
            x = matrix(blob, dim)
            out.append(pa.table({"vec_id": pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool)), "cluster": pa.array(label), "distance": pa.array(((x - last[label]) ** 2).sum(1))}))
        return pa.concat_tables(out) if out else pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())]).empty_table()

    rows = held.groupBy("block").cogroup(state.select("block", "labels").groupBy("block")).applyInArrow(tell, "vec_id long, cluster int, distance long")
    return rows, centroids, inertia


def first_by(order: Column, vectors: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors that stand first (ties: the smaller components): ``k x dim`` numbers on the driver."""
    return [list(r.v) for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]


def op13_centroids(spark, sf_dir: str, k: int = 8, rounds: int = 10, dim: int = 64) -> DataFrame:
    vectors = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dim=dim)
    start = first_by(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256), vectors, k)
    rows, centroids, inertia = sort_means(vectors, start, rounds, dim)
    most = (1 << 63) - 1
    fits = lambda n: n if n <= most else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(i, fits(n), d) for i, (n, d) in enumerate(zip(inertia, digest, strict=True))], "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(sum(inertia))).cast("long").alias("inertia"), "centroid_sha256")  # k rows are broadcast


def oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Every round in full, in SQL: all distances, no bound."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(1024 * x::DOUBLE) < {LIMIT})) = {dim})""",
        "e AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM s)",
    ]
    for i in range(rounds + 1):
        parts.append(f"t{i} AS (SELECT e.r, k.c, sum((e.x - k.x) * (e.x - k.x)) AS s FROM e JOIN c{i} k USING (d) GROUP BY e.r, k.c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, c, s FROM t{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT a.c, e.d, sum(e.x)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN e USING (r) GROUP BY a.c, e.d)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k.c, k.d, coalesce((s - ((s % n) + n) % n) // n, k.x)::BIGINT AS x FROM c{i} k LEFT JOIN m{i} m ON m.c = k.c AND m.d = k.d)")
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.s::BIGINT AS distance, (sum(a.s) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.s) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN h ON h.c = a.c"""


ORACLE = oracle()
