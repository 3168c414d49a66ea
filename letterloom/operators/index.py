"""Indexes that follow a store from version to version: an inverted index for BM25 and balls of vectors for exact cosine search.

Both are chains of segments on disk. ``update`` asks the store which letters have changed since the version that the index has seen, reads these letters
only, and writes a segment with their new entries and with the places (``ord``) of the entries that no longer count. After ``CHAIN`` segments, or where the store's
history is gone, the next one is built anew from the whole state. ``HEADER`` is put in place last, as in the store. One writer at a time for each index; it can be
built again at any moment.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_counts, tokenize
from .retrieve import B, EPSILON, K1, raw_idf
from .store import Store, matches, similarity

CHAIN = 8
#: Postings of a block.
BLOCK = 128
#: Vectors that choose the balls' centres, and how many of these there are at most.
SAMPLE, CENTRES = 20_000, 4_096
#: Rounds by which centres settle in the sample, and what floating sums may be wrong by.
ROUNDS, SLACK = 4, 1e-6
FIELDS = ["department", "letter_type"]


class Following:
    """Segments ``root/s<n>`` that follow a store."""

    def __init__(self, store: Store, root: str):
        self.store, self.spark, self.root = store, store.spark, root.rstrip("/")
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted((int(n[1:]) for n in names if n[:1] == "s" and n[1:].isdigit()), reverse=True)

    def head(self) -> dict | None:
        for n in self._numbers():
            if self._fs.exists(self._path(f"{self.root}/s{n}/HEADER")):
                return json.loads(self.spark.read.text(f"{self.root}/s{n}/HEADER", wholetext=True).first().value)
        return None

    def read(self, part: str, head: dict, schema: str) -> DataFrame:
        """A part of all segments, with the segment's number as ``seg``."""
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.root}/s{n}/{part}").withColumn("seg", F.lit(n)) for n in head["segments"]))

    def living(self, entries: DataFrame, head: dict) -> DataFrame:
        """Entries ``ord, seg`` that no later segment has replaced or removed."""
        if len(head["segments"]) == 1:
            return entries
        dead = self.read("dead", head | {"segments": head["segments"][1:]}, "ord bigint").groupBy("ord").agg(F.max("seg").alias("_dead"))
        return entries.join(dead, "ord", "left").where(F.col("_dead").isNull() | (F.col("_dead") <= F.col("seg"))).drop("_dead")

    def update(self) -> dict:
        """Catch up with the store; its header."""
        head, version = self.head(), self.store.version()
        if head is not None and head["store"] == version:
            return head
        changed = self.store.changed_keys(head["store"]) if head is not None and len(head["segments"]) < CHAIN else None
        number = max(self._numbers(), default=-1) + 1
        folder = f"{self.root}/s{number}"
        if changed is None:
            said, segments = self.write(folder, self.store.rows(), None, None), [number]
        else:
            changed = changed.distinct()
            rows = self.store.near(changed).join(changed, "letter_id", "left_semi")
            said, segments = self.write(folder, rows, changed, head), [*head["segments"], number]
        new = {"store": version, "segments": segments, "number": number} | said
        out = self._fs.create(self._path(f"{folder}/.HEADER"), True)
        out.write(json.dumps(new).encode())
        out.close()
        if not self._fs.rename(self._path(f"{folder}/.HEADER"), self._path(f"{folder}/HEADER")):
            raise OSError(f"cannot set {folder}/HEADER")
        return new

    def prune(self) -> None:
        """Remove segments that the newest header does not name."""
        head = self.head()
        for n in self._numbers():
            if head and n not in head["segments"]:
                self._fs.delete(self._path(f"{self.root}/s{n}"), True)

    def write(self, folder: str, rows: DataFrame, changed: DataFrame | None, head: dict | None) -> dict:
        raise NotImplementedError


DOCS = "letter_id string, ord bigint, department string, letter_type string, n_terms int, terms array<struct<term: string, tf: int>>"
BLOCKS = "term string, department string, letter_type string, tf int, n_terms int, ords array<bigint>, tfs array<int>, sizes array<int>"
COUNTS = "department string, letter_type string, term string, df bigint"
SIZES = "department string, letter_type string, n bigint, total bigint"


class TermIndex(Following):
    """Postings in blocks of one term, department and letter type each, the weightiest first, with the largest count and the least length of a block:
    these bound what a letter of the block can score, whatever the mean length is.

    Document frequencies stand by department and letter type, as differences from segment to segment, so that filters count before anything is ranked.
    A query reads the blocks and frequencies of its own terms; all frequencies only if one of its terms stands in over half of the candidates, as the floor for negative
    weights is a share of the mean.
    """

    def write(self, folder: str, rows: DataFrame, changed: DataFrame | None, head: dict | None) -> dict:
        text = rows.select("letter_id", "ord", *FIELDS, tokenize("document").alias("tokens"))
        terms = F.coalesce(term_counts("tokens"), F.array().cast("array<struct<term: string, tf: int>>"))  # the words of one letter, counted in its row
        text.select("letter_id", "ord", *FIELDS, F.size("tokens").alias("n_terms"), terms.alias("terms")).write.parquet(f"{folder}/docs")
        docs = self.spark.read.schema(DOCS).parquet(f"{folder}/docs")
        minus = None
        if changed is not None:
            # Letters' words stand in the order of the store's files, so what lies outside the changed keys is not read, let alone shuffled.
            least, most = changed.agg(F.min("letter_id"), F.max("letter_id")).first()
            within = self.read("docs", head, DOCS).where(F.col("letter_id").between(F.lit(least), F.lit(most)))
            old = self.living(within, head).join(changed, "letter_id", "left_semi")
            old.select("ord", *FIELDS, "n_terms", "terms").write.parquet(f"{folder}/old")
            minus = self.spark.read.schema(DOCS).parquet(f"{folder}/old")
            minus.select("ord").write.parquet(f"{folder}/dead")
        mean = docs.agg(F.avg("n_terms")).first()[0] or 1.0
        entry = docs.select(*FIELDS, "ord", "n_terms", F.explode("terms").alias("t")).select(F.col("t.term").alias("term"), *FIELDS, "ord", F.col("t.tf").alias("tf"), "n_terms")
        weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / mean))
        # Ranges are cut by weight and place, too, so that a word that all letters have is no partition of its own.
        order = ["term", *FIELDS, F.desc("weight"), "ord"]
        entry.withColumn("weight", weight).repartitionByRange(*order).sortWithinPartitions(*order).drop("weight").mapInArrow(blocks(BLOCK), BLOCKS).write.parquet(f"{folder}/blocks")
        # A posting is a letter that has the term, so blocks are counted and letters need not be opened up again.
        df = self.spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select(*FIELDS, "term", F.size("ords").alias("df"))
        signed = lambda rows, sign: rows.select(*FIELDS, "n_terms", F.lit(sign).alias("sign"))
        both = signed(docs, 1)
        if minus is not None:
            df = df.unionAll(minus.select(*FIELDS, F.explode("terms.term").alias("term"), F.lit(-1).alias("df")))
            both = both.unionAll(signed(minus, -1))
        df = df.groupBy(*FIELDS, "term").agg(F.sum("df").alias("df")).where("df <> 0")
        df.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/df")
        both.groupBy(*FIELDS).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("n_terms")).alias("total")).write.parquet(f"{folder}/sizes")
        return {}

    def _weights(self, head: dict, terms: Sequence[str], where: dict | None) -> tuple[dict[str, float], float]:
        """The idf of the query's terms under the filter, and the mean length."""
        sizes = self.read("sizes", head, SIZES).where(matches(where)).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        if not sizes.n or not sizes.total:
            return {}, 0.0
        df = self.read("df", head, COUNTS).where(matches(where))
        idf = lambda rows: rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").select("term", raw_idf(F.lit(sizes.n), F.col("df")).alias("idf"))
        own = {r.term: r.idf for r in idf(df.where(F.col("term").isin(sorted(set(terms))))).collect()}
        if any(v < 0 for v in own.values()):
            mean = idf(df).agg(F.avg("idf")).first()[0]
            own = {t: v if v >= 0 else EPSILON * mean for t, v in own.items()}
        return own, sizes.total / sizes.n

    def _part(self, weights: dict[str, float], mean: float, terms: Sequence[str], tf: Column, size: Column) -> Column:
        weight = F.create_map(*[F.lit(x) for t in weights for x in (t, weights[t] * list(terms).count(t))])
        return weight[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))

    def scores(self, terms: Sequence[str], where: dict | None = None) -> DataFrame:
        """``ord, bm25`` of the candidates that have one of the terms; all others score 0."""
        head = self.update()
        weights, mean = self._weights(head, terms, where)
        return self._scored(self._blocks(head, weights, where), head, weights, mean, terms)

    def _blocks(self, head: dict, weights: dict[str, float], where: dict | None) -> DataFrame:
        return self.read("blocks", head, BLOCKS).where(F.col("term").isin(sorted(weights))).where(matches(where))

    def _scored(self, found: DataFrame, head: dict, weights: dict[str, float], mean: float, terms: Sequence[str]) -> DataFrame:
        if not weights:
            return self.spark.createDataFrame([], "ord bigint, bm25 double")
        entries = found.select("term", "seg", F.explode(F.arrays_zip("ords", "tfs", "sizes")).alias("e")).select("term", "seg", F.col("e.ords").alias("ord"), F.col("e.tfs").alias("tf"), F.col("e.sizes").alias("size"))
        part = self._part(weights, mean, terms, F.col("tf").cast("double"), F.col("size"))
        return self.living(entries.withColumn("part", part), head).groupBy("ord").agg(F.sum("part").alias("bm25"))

    def top(self, terms: Sequence[str], k: int, where: dict | None = None) -> tuple[DataFrame, dict]:
        """``ord, bm25`` of the k best (ties: the smaller ``ord``; letters without any of the terms score 0), and how many of the terms' blocks were read.

        The best block of each term, as it stands first, gives a score that k letters reach. A block is read only if the most that a letter of it can score, with
        the most that the other terms can add, reaches that too. (A letter that also stands in a block that is left out can't reach it, so what it lacks there does no harm.)
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        head = self.update()
        weights, mean = self._weights(head, terms, where)
        told = {"blocks": 0, "read": 0}
        hits = self.spark.createDataFrame([], "ord bigint, bm25 double")
        if weights:
            found = self._blocks(head, weights, where)
            bound = self._part(weights, mean, terms, F.col("tf").cast("double"), F.col("n_terms"))
            most = {r.term: (r.m, r.n) for r in found.groupBy("term").agg(F.max(bound).alias("m"), F.count("*").alias("n")).collect()}
            told["blocks"] = told["read"] = sum(n for _, n in most.values())
            if all(w >= 0 for w in weights.values()) and most:
                every = sum(m for m, _ in most.values())
                first = {t: m * (1 - 1e-12) for t, (m, _) in most.items()}
                limit = F.create_map(*[F.lit(x) for t in first for x in (t, first[t])])
                sure = self._scored(found.where(bound >= limit[F.col("term")]), head, weights, mean, terms).orderBy(F.desc("bm25")).limit(k).collect()
                if len(sure) == k:
                    rest = F.create_map(*[F.lit(x) for t, (m, _) in most.items() for x in (t, every - m)])
                    found = found.where(bound + rest[F.col("term")] >= sure[-1].bm25 * (1 - 1e-9))
                    told["read"] = found.count()
            hits = self._scored(found, head, weights, mean, terms)
        best = hits.orderBy(F.desc("bm25"), "ord").limit(k)
        rows = best.collect()  # k rows
        if len(rows) < k or rows[-1].bm25 <= 0:
            others = self.living(self.read("docs", head, DOCS).where(matches(where)).select("ord", "seg"), head).select("ord")
            every = others.join(hits, "ord", "left").select("ord", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
            rows = every.orderBy(F.desc("bm25"), "ord").limit(k).collect()
        return self.spark.createDataFrame([(r.ord, r.bm25) for r in rows], "ord bigint, bm25 double"), told


def blocks(size: int):
    """Sorted postings, cut where term or fields change and after ``size``."""
    schema = pa.schema([("term", pa.string()), ("department", pa.string()), ("letter_type", pa.string()), ("tf", pa.int32()), ("n_terms", pa.int32()), ("ords", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])

    def closed(rows: pa.Table, starts: np.ndarray, n: int) -> pa.RecordBatch:
        """The blocks of the first ``n`` rows, which begin at ``starts``."""
        first, own = rows.take(pa.array(starts)), rows.slice(0, n)
        ords, tfs, sizes = (own.column(i).combine_chunks() for i in (3, 4, 5))
        offsets = pa.array(np.append(starts, n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (ords, tfs, sizes)]
        most, least = np.maximum.reduceat(tfs.to_numpy(), starts), np.minimum.reduceat(sizes.to_numpy(), starts)
        return pa.RecordBatch.from_arrays([*(first.column(i).combine_chunks() for i in range(3)), pa.array(most), pa.array(least), *lists], schema=schema)

    def run(batches):
        held = None  # the block that further rows may belong to
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_arrays([batch.column(i) for i in range(6)], names=list("abcdef"))
            rows = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            at, cut = np.arange(rows.num_rows), np.zeros(rows.num_rows, bool)
            cut[0] = True
            for i in range(3):
                cut[1:] |= np.diff(rows.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(cut, at, 0))) % size == 0)
            if len(starts) > 1:
                yield closed(rows, starts[:-1], int(starts[-1]))
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield closed(held, np.zeros(1, np.int64), held.num_rows)

    return run


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors that a sample of unit vectors gathers around."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


ENTRIES = "ord bigint, letter_id string, department string, letter_type string, embedding array<float>, ball int"
BALLS = "ball int, radius double, n bigint"
LOOSE, ZERO = -1, -2


class BallIndex(Following):
    """Unit vectors in balls (a centre and the largest distance from it). By the triangle inequality no vector of a ball is nearer to the query than the centre's distance less the
    radius, so balls beyond the k-th distance found so far are skipped; results are those of a full scan.

    Centres come from a sample of ``SAMPLE`` vectors, every vector stands in the ball of its nearest centre; letters without a vector or with one of length 0 (cosine 0 with everything) have a ball of their own,
    and so have letters that changed since the centres were chosen (always scanned), up to the next whole.
    """

    def write(self, folder: str, rows: DataFrame, changed: DataFrame | None, head: dict | None) -> dict:
        rows = rows.select("ord", "letter_id", *FIELDS, "embedding")
        n, dim = rows.count(), self.store.dimension
        if changed is not None:
            old = self.living(self.read("entries", head, ENTRIES), head).join(changed, "letter_id", "left_semi")
            old.select("ord").write.parquet(f"{folder}/dead")
            rows.withColumn("ball", F.lit(LOOSE)).write.partitionBy("ball").parquet(f"{folder}/entries")
            self.spark.createDataFrame([(LOOSE, 0.0, n)], BALLS).write.parquet(f"{folder}/balls")
            return {"centres": head["centres"]}
        some = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("letter_id"), "letter_id").limit(SAMPLE).select("embedding").collect()
        sample = np.array([r.embedding for r in some], np.float64).reshape(-1, dim)
        length = np.sqrt((sample * sample).sum(1, keepdims=True))
        sample = (sample / np.where(length > 0, length, 1))[length[:, 0] > 0]
        count = max(1, min(math.isqrt(n), CENTRES))
        centres = centres_of(sample, count) if len(sample) else np.zeros((0, dim))

        def place(batches):
            for batch in batches:
                own = batch.column("embedding")
                fits = np.asarray(own.value_lengths().fill_null(0)) == dim
                x = np.zeros((batch.num_rows, dim))
                x[fits] = np.asarray(own.filter(pa.array(fits)).flatten()).astype(np.float64).reshape(-1, dim)
                length = np.sqrt((x * x).sum(1))
                unit = x / np.where(length > 0, length, 1)[:, None]
                ball = (unit @ centres.T).argmax(1) if len(centres) else np.zeros(len(x), np.int64)
                far = np.sqrt(((unit - centres[ball]) ** 2).sum(1)) if len(centres) else np.zeros(len(x))
                ball = np.where(length > 0, ball, ZERO)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "ball", "far"])

        placed = rows.mapInArrow(place, f"{ENTRIES}, far double")
        parts = max(1, min(count + 1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        placed.repartitionByRange(parts, "ball", "letter_id").sortWithinPartitions("ball").write.partitionBy("ball").parquet(f"{folder}/entries")
        there = self.spark.read.schema(f"{ENTRIES}, far double").parquet(f"{folder}/entries")
        there.groupBy("ball").agg(F.max("far").alias("radius"), F.count("*").alias("n")).write.parquet(f"{folder}/balls")
        return {"centres": centres.tolist()}

    def query(self, vector: Sequence[float], k: int, where: dict | None = None) -> tuple[DataFrame, dict]:
        """``ord, letter_id, distance`` of the k nearest that match (ties: the smaller ``ord``), and how many of the vectors were measured."""
        if k < 1:
            raise ValueError("k must be at least 1")
        head = self.update()
        v = np.array(vector, np.float64)
        length = float(np.sqrt((v * v).sum()))
        centres = np.array(head["centres"], np.float64).reshape(-1, len(v))
        balls = self.read("balls", head, BALLS).groupBy("ball").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()  # a row a ball
        # Unit vectors at distance d have cosine 1 - d * d / 2.
        away = {r.ball: max(0.0, float(np.sqrt(((v / length - centres[r.ball]) ** 2).sum())) - (r.radius or 0.0) - SLACK) if r.ball >= 0 and length > 0 else 0.0 for r in balls}
        bound = {b: d * d / 2 for b, d in away.items()} | ({ZERO: 1.0} if length > 0 and ZERO in away else {})
        size = {r.ball: r.n for r in balls}
        query = F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>")
        rows = self.read("entries", head, ENTRIES).where(matches(where))
        measured = lambda own: self.living(rows.where(F.col("ball").isin(own)), head).withColumn("distance", 1 - similarity("embedding", query)).select("ord", "letter_id", "distance")
        order, found, seen, step = sorted(bound, key=lambda b: (bound[b], b)), [], 0, 0
        while seen < len(order):
            worst = found[-1].distance if len(found) == k else math.inf
            ahead = [b for b in order[seen:] if bound[b] <= worst]
            if not ahead:
                break
            take, held = [], 0
            for b in ahead:  # first what k needs, then everything that can still matter
                take.append(b)
                held += size[b]
                if step == 0 and held >= 4 * k:
                    break
            new = measured(take).orderBy("distance", "ord").limit(k).collect()
            found = sorted([*found, *new], key=lambda r: (r.distance, r.ord))[:k]
            seen, step = seen + len(take), step + 1
        return self.spark.createDataFrame([tuple(r) for r in found], "ord bigint, letter_id string, distance double"), {"vectors": sum(size.values()), "measured": sum(size[b] for b in order[:seen])}
