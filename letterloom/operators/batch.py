"""Many queries at once: hybrid retrieval for a table of queries, with the rows and ranks that :func:`.retrieve.retrieve` gives for each alone.

Queries travel to the tasks in slices of ``SLICE``; candidates stay where they are read, with counts of the queries' terms in place of their words. A task scores blocks of
``ROWS`` candidates (fewer where a slice has very many terms) against all queries of the slice, so its memory follows neither the table nor a text, and keeps
the best ``2 (60 + k)`` of each query and list in a bounded heap: that is the partial aggregation, so what is shuffled follows tasks and queries, never candidates times
queries. A second pass counts for each kept candidate how many others stand before it. So a slice takes two passes, however many queries it has.

Sums run in the order of the expressions of :mod:`.retrieve`, term by term and component by component, so that copies tie here as they do there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import B, EPSILON, K1, RRF, raw_idf, with_tokens
from .store import matches

SLICE = 1024
#: Candidates that are scored at once, and numbers that a block may have for them and the terms of a slice.
ROWS, NUMBERS = 1024, 1 << 22
#: Texts that a task gets at once, as they may be long.
TEXTS = 256
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
LISTS = ("bm25", "cosine")


def weights_of(tokenized: DataFrame, terms: list[str]) -> tuple[dict[str, float], float]:
    """As :func:`.retrieve.term_weights`, for any number of terms: these join the counts, of which the driver sees no others."""
    each = F.concat(F.array(F.lit("")), F.array_distinct("tokens"))
    counted = tokenized.select(F.explode(each).alias("term"), "n_terms").groupBy("term").agg(F.count("*").alias("df"), F.sum("n_terms").alias("size")).persist()
    try:
        every = counted.where("term = ''").first()
        if every is None or not every["size"]:
            return {}, 0.0
        idf = counted.where("term <> ''").select("term", raw_idf(F.lit(every.df), F.col("df")).alias("idf"))
        mean = idf.agg(F.avg("idf")).first()[0]
        wanted = tokenized.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
        found = idf.join(wanted, "term").collect()  # the queries' terms
    finally:
        counted.unpersist()
    return {r.term: (r.idf if r.idf >= 0 else EPSILON * mean) for r in found}, every["size"] / every.df


def counted(tokenized: DataFrame, terms: list[str]) -> DataFrame:
    """``ord, n_terms, embedding`` and how often each of ``terms`` (by number) stands in a letter, where it does."""
    kinds = "ord long, n_terms int, embedding array<float>, terms array<int>, tfs array<int>"

    def count(batches):
        known = pa.array(terms, pa.string())
        for batch in batches:
            tokens = batch.column("tokens")
            term = pc.index_in(tokens.flatten(), value_set=known)
            row = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths().fill_null(0)))
            held = np.asarray(term.is_valid())
            at, tf = np.unique(row[held] * max(len(terms), 1) + np.asarray(term.drop_null()), return_counts=True)
            row, term = np.divmod(at, max(len(terms), 1))
            ends = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.record_batch([batch.column("ord"), batch.column("n_terms"), batch.column("embedding"), *lists], ["ord", "n_terms", "embedding", "terms", "tfs"])

    vector = F.coalesce("embedding", F.array().cast("array<float>")).cast("array<float>")
    return tokenized.select(F.col("ord").cast("long").alias("ord"), "tokens", F.col("n_terms").cast("int").alias("n_terms"), vector.alias("embedding")).mapInArrow(count, kinds)


class Scorer:
    """The queries of a slice, ready to score blocks of candidates. ``terms`` are those that :func:`counted` has numbered."""

    def __init__(self, words: list[list[str]], vectors: np.ndarray, weights: dict[str, float], mean: float, terms: list[str]):
        number = {t: i for i, t in enumerate(terms)}
        known = [[number[t] for t in own if t in weights] for own in words]
        used = np.unique(np.array([t for own in known for t in own], np.int64))
        self.place = np.full(len(terms), -1)
        self.place[used] = np.arange(len(used))
        self.weights, self.mean, self.vectors = np.array([weights[terms[i]] for i in used]), mean, vectors
        # Of each position in a query those that have a term there, and its place.
        self.steps = []
        for k in range(max(map(len, known), default=0)):
            q = np.array([i for i, own in enumerate(known) if len(own) > k])
            self.steps.append((q, self.place[[known[i][k] for i in q]]))
        self.rows = max(1, min(ROWS, NUMBERS // max(len(used), 1)))
        total = np.zeros(len(vectors))
        for c in vectors.T:
            total = total + c * c
        self.norms = np.sqrt(total)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= self.rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(self.rows)
                held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(self.rows)

    def bm25(self, terms: pa.ListArray, tfs: pa.ListArray, sizes: np.ndarray) -> np.ndarray:
        """``(candidates, queries)``"""
        out = np.zeros((len(sizes), len(self.vectors)))
        if not self.steps:
            return out
        tf = np.zeros((len(sizes), len(self.weights)))
        row, place = np.repeat(np.arange(len(sizes)), np.asarray(terms.value_lengths())), self.place[np.asarray(terms.flatten())]
        held = place >= 0
        tf[row[held], place[held]] = np.asarray(tfs.flatten())[held]
        below = tf + K1 * (1 - B + B * sizes.astype(np.float64) / self.mean)[:, None]
        tf *= self.weights
        tf *= K1 + 1
        tf /= below
        for q, j in self.steps:
            out[:, q] += tf[:, j]
        return out

    def cosine(self, embedding: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(embedding), len(self.vectors)))
        # What has no vector, or one of another length, has cosine 0.
        fits = np.asarray(embedding.value_lengths().fill_null(0)) == self.vectors.shape[1]
        if not fits.any():
            return out
        x = np.asarray(embedding.filter(pa.array(fits)).flatten()).astype(np.float64).reshape(-1, self.vectors.shape[1])
        dot, own, part = np.zeros((len(x), len(self.vectors))), np.zeros(len(x)), np.empty((len(x), len(self.vectors)))
        for c, v in zip(x.T, self.vectors.T, strict=True):
            dot += np.multiply(c[:, None], v[None, :], out=part)
            own = own + c * c
        np.multiply(np.sqrt(own)[:, None], self.norms[None, :], out=part)
        out[fits] = np.divide(dot, part, out=np.zeros_like(dot), where=part != 0)
        return out

    def score(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, self.bm25(batch.column("terms"), batch.column("tfs"), np.asarray(batch.column("n_terms")))
        yield 1, self.cosine(batch.column("embedding"))


class Heaps:
    """The ``size`` best of each query: the highest score, then the smallest ``ord``."""

    def __init__(self, queries: int, size: int):
        self.size, self.limit, self.last = size, np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)
        self.q, self.s, self.o, self.held = [], [], [], 0

    def add(self, scores: np.ndarray, ords: np.ndarray) -> None:
        row, q = np.nonzero((scores > self.limit) | ((scores == self.limit) & (ords[:, None] < self.last)))
        self.q.append(q), self.s.append(scores[row, q]), self.o.append(ords[row])
        self.held += len(q)
        if self.held > 4 * self.size * len(self.limit):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, o = (np.concatenate(x) if x else np.zeros(0) for x in (self.q, self.s, self.o))
        order = np.lexsort((o, -s, q))
        q, s, o = q[order].astype(np.int64), s[order], o[order].astype(np.int64)
        start = np.searchsorted(q, np.arange(len(self.limit)))
        rank = np.arange(len(q)) - start[q]
        full = rank == self.size - 1
        self.limit[q[full]], self.last[q[full]] = s[full], o[full]
        kept = rank < self.size
        self.q, self.s, self.o, self.held = [q[kept]], [s[kept]], [o[kept]], int(kept.sum())
        return self.q[0], self.s[0], self.o[0]


def places(scores: np.ndarray, ords: np.ndarray, marks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the marks (negated scores and ords, sorted) stand before each candidate or at it."""
    s, o = marks
    left, right = np.searchsorted(s, -scores, "left"), np.searchsorted(s, -scores, "right")
    out = left.copy()
    tied = np.flatnonzero(left < right)
    for a in np.unique(left[tied]).tolist():
        own = tied[left[tied] == a]
        out[own] += np.searchsorted(o[a : right[own[0]]], ords[own], "right")
    return out


def retrieve_many(letters: DataFrame, queries: DataFrame, k: int = 5, where: dict | None = None, text: str = "text", key: str = "letter_id") -> DataFrame:
    """``qid, rank, <key>, bm25_rank, semantic_rank, fused_score`` of the k best for each query.

    ``letters`` is as for :func:`.retrieve.retrieve`; ``queries`` has ``qid`` (long, different for each), ``query`` and ``vector``, and is read slice by slice.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, m = letters.sparkSession, 2 * (RRF + k)
    rows = sorted(queries.select("qid", "query", "vector").collect(), key=lambda r: r.qid)  # queries, not candidates
    words = [re.findall(r"\w+", (r.query or "").lower()) for r in rows]
    tokenized = with_tokens(letters.where(matches(where)), text)
    weights, mean = weights_of(tokenized, [t for own in words for t in own])
    terms = sorted(weights)
    candidates = counted(tokenized, terms).persist()
    best: list[tuple] = []
    before = spark.conf.get(ARROW, None)
    try:
        spark.conf.set(ARROW, str(min(TEXTS, int(before)) if before and int(before) > 0 else TEXTS))
        for first in range(0, len(rows), SLICE):
            part = range(first, min(first + SLICE, len(rows)))
            scorer = Scorer([words[i] for i in part], np.array([rows[i].vector for i in part], np.float64), weights, mean, terms)
            best += one_slice(candidates, [rows[i].qid for i in part], scorer, m, k)
    finally:
        candidates.unpersist()
        spark.conf.unset(ARROW) if before is None else spark.conf.set(ARROW, before)
    placed = spark.createDataFrame(best, "qid long, rank int, ord long, bm25_rank int, semantic_rank int, fused_score double")
    return letters.select("ord", key).join(placed, "ord").select("qid", "rank", key, "bm25_rank", "semantic_rank", "fused_score")


def one_slice(candidates: DataFrame, ids: list[int], scorer: Scorer, m: int, k: int) -> list[tuple]:
    """``(qid, rank, ord, bm25_rank, semantic_rank, fused_score)`` for the queries of one slice."""
    n = len(ids)

    def keep(batches):
        heaps = [Heaps(n, m) for _ in LISTS]
        for batch in scorer.blocks(batches):
            ords = np.asarray(batch.column("ord")).astype(np.int64)
            for i, scores in scorer.score(batch):
                heaps[i].add(scores, ords)
        for i, heap in enumerate(heaps):
            q, s, o = heap.fold()
            yield pa.record_batch({"list": pa.array(np.full(len(q), i, np.int32)), "q": pa.array(q), "score": pa.array(s.astype(np.float64)), "ord": pa.array(o)})

    def again(group: pd.DataFrame) -> pd.DataFrame:
        return group.sort_values(["score", "ord"], ascending=[False, True]).head(m)  # at most m rows from each task

    kinds = "list int, q long, score double, ord long"
    heads = candidates.mapInArrow(keep, kinds).groupBy("list", "q").applyInPandas(again, kinds).toPandas()  # at most 2 m rows a query
    # What stands in the head of either list is ranked in both.
    pairs = heads[["q", "ord"]].drop_duplicates()
    pairs = pairs.sort_values("ord")
    asking = pairs.q.to_numpy(np.int64)
    every, begin, asked = np.unique(pairs.ord.to_numpy(np.int64), return_index=True, return_counts=True)

    def measure(batches):
        for batch in scorer.blocks(batches):
            ords = np.asarray(batch.column("ord")).astype(np.int64)
            at = np.flatnonzero(np.isin(ords, every))
            batch, ords = batch.take(pa.array(at)), ords[at]
            place = np.searchsorted(every, ords)
            # Of each candidate the queries that want it, all in one step.
            n = asked[place]
            row, step = np.repeat(np.arange(len(ords)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = asking[begin[place[row]] + step]
            for i, scores in scorer.score(batch) if len(at) else ():
                yield pa.record_batch({"list": pa.array(np.full(len(q), i, np.int32)), "q": pa.array(q), "score": pa.array(scores[row, q]), "ord": pa.array(ords[row])})

    marked = candidates.mapInArrow(measure, kinds).toPandas()
    marks = {}
    for (i, q), g in marked.groupby(["list", "q"]):
        g = g.sort_values(["score", "ord"], ascending=[False, True])
        marks[int(i), int(q)] = (-g.score.to_numpy(np.float64), g.ord.to_numpy(np.int64))

    def count(batches):
        held = {at: np.zeros(len(s) + 1, np.int64) for at, (s, _) in marks.items()}
        for batch in scorer.blocks(batches):
            ords = np.asarray(batch.column("ord")).astype(np.int64)
            for i, scores in scorer.score(batch):
                for q in range(n):
                    if (own := held.get((i, q))) is not None:
                        own += np.bincount(places(scores[:, q], ords, marks[i, q]), minlength=len(own))
        for (i, q), own in held.items():
            at = np.flatnonzero(own)
            yield pa.record_batch({"list": pa.array(np.full(len(at), i, np.int32)), "q": pa.array(np.full(len(at), q)), "place": pa.array(at), "n": pa.array(own[at])})

    counts = candidates.mapInArrow(count, "list int, q long, place long, n long").groupBy("list", "q", "place").agg(F.sum("n").alias("n")).toPandas()
    ranks: dict[int, list[dict[int, int]]] = {q: [{}, {}] for q in range(n)}
    for (i, q), g in counts.groupby(["list", "q"]):
        s, o = marks[int(i), int(q)]
        before = np.zeros(len(s) + 1, np.int64)
        before[g.place.to_numpy()] = g.n.to_numpy()
        ranks[int(q)][int(i)] = dict(zip(o.tolist(), (np.cumsum(before)[: len(s)] + 1).tolist(), strict=True))
    out = []
    for q, (a, b) in ranks.items():
        scored = sorted(((-(1 / (RRF + a[o]) + 1 / (RRF + b[o])), a[o], o) for o in a), key=lambda x: x[:2])[:k]
        out += [(ids[q], i + 1, o, a[o], b[o], -s) for i, (s, _, o) in enumerate(scored)]
    return out
