"""Periodic runs of words, by the runs theorem.

A *run* is a stretch with a smallest period ``q`` that no neighbouring word extends. Every run has a root (``q`` consecutive words of it) that is the longest
Lyndon word at its place under one of two orders, that of the words or its reverse. So:

1. a suffix array of the words gives the inverse (the rank of each suffix) and, of neighbours in it, the longest common prefixes (LCP);
2. the longest Lyndon word at a place ends before the next smaller rank, under the reverse order before the next larger one;
3. each such word is taken as a root and extended: to the right by the common prefix of the suffixes at its beginning and its end (a minimum over
   LCP, answered by a sparse table), to the left likewise on the reversed words. At least twice its length in all is a run.

Documents of a chunk share one suffix array; each ends in a sign of its own, so no match crosses a border. Only documents with a root that extends far enough to
the right need the array of reversed words: the leftmost root of a run lacks less than ``q`` words to the left, so of a run of ``exponent`` periods it has
``exponent - 2`` and more to its right beyond itself.

Whole texts are worked on in their scan tasks, without a shuffle; memory follows the longest document. Rows: every input row gives one row; null and empty
texts have no words and no runs; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packs as P

#: Words of the documents that share a suffix array, about.
CHUNK = 40_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("kept", pa.binary())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"


def suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix and, by rank, its common prefix with the suffix before it. No suffix may be the beginning of another one.

    Prefix doubling; in each round only suffixes whose rank is still shared are sorted. Equal ranks in round k mean equal 2**k first signs, from which the
    common prefixes are put together.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    where = np.arange(n)
    head = np.r_[True, x[order[1:]] != x[order[:-1]]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, where, 0))
    rounds, h = [rank], 1
    left = where[~(head & np.r_[head[1:], True])] if n else where
    while len(left):
        at = order[left]
        group, then = rank[at], rank[at + h]
        o = np.lexsort((then, group))
        at, group, then = at[o], group[o], then[o]
        order[left] = at
        head = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(head, left, 0))
        rounds.append(rank)
        left, h = left[~(head & np.r_[head[1:], True])], 2 * h
    common = np.zeros(n, np.int32)
    if n:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(rounds) - 1, -1, -1):
            same = np.flatnonzero(rounds[k][a] == rounds[k][b])
            a[same] += 1 << k
            b[same] += 1 << k
        common[1:] = b - order[1:]
    return rank, common


def table_of(x: np.ndarray, best=np.minimum) -> list[np.ndarray]:
    """A sparse table: the least (or largest) of each 2**k consecutive values."""
    out = [x]
    while len(out[-1]) > 1 << (len(out) - 1):
        h = 1 << (len(out) - 1)
        out.append(best(out[-1][:-h], out[-1][h:]))
    return out


def least_in(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each range ``[a, b)``, none empty."""
    k = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for level in np.unique(k).tolist():
        own = np.flatnonzero(k == level)
        out[own] = np.minimum(table[level][a[own]], table[level][b[own] - (1 << level)])
    return out


def next_beyond(x: np.ndarray, table: list[np.ndarray], beyond) -> np.ndarray:
    """For each place the next one whose value is ``beyond`` its own (``np.less``: smaller), or the end; ``table`` holds that kind of extremes."""
    n, at = len(x), np.arange(1, len(x) + 1)
    for k in range(len(table) - 1, -1, -1):
        size = len(table[k])
        inside = np.flatnonzero(at < size)
        skip = inside[~beyond(table[k][at[inside]], x[inside])]
        at[skip] += 1 << k
    return np.minimum(at, n)


class Matches:
    """Common prefixes of any two suffixes."""

    def __init__(self, x: np.ndarray):
        self.rank, self.common = suffixes(x)
        self.table = table_of(self.common)

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return least_in(self.table, np.minimum(a, b) + 1, np.maximum(a, b) + 1).astype(np.int64)


def closed(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words (numbers from 0), each followed by a sign of its own below all words; and where each document begins (and the end)."""
    n = len(docs)
    ends = np.cumsum([len(d) + 1 for d in docs], dtype=np.int64)
    x = np.empty(int(ends[-1]) if n else 0, np.int64)
    for k, (d, b) in enumerate(zip(docs, ends.tolist(), strict=True)):
        x[b - 1 - len(d) : b - 1], x[b - 1] = d + n, k
    return x, np.r_[0, ends]


def roots(docs: list[np.ndarray]) -> tuple[Matches, np.ndarray, np.ndarray, np.ndarray]:
    """Longest Lyndon words under both orders: matches, bounds, and the place and length of each within its document."""
    x, bounds = closed(docs)
    found = Matches(x)
    end = np.repeat(bounds[1:] - 1, np.diff(bounds))
    place = np.arange(len(x))
    both = []
    for table, beyond in ((table_of(found.rank), np.less), (table_of(found.rank, np.maximum), np.greater)):
        stop = next_beyond(found.rank, table, beyond)
        ok = (place < end) & (stop <= end)
        both.append((place[ok], (stop - place)[ok]))
    at, size = (np.concatenate(c) for c in zip(*both, strict=True))
    return found, bounds, at, size


def runs_of(docs: list[np.ndarray], least: int, exponent: int) -> list[np.ndarray]:
    """Of each document (words as numbers from 0) the runs of ``exponent`` periods and ``least`` words, as rows ``start, length, period`` by start and period."""
    none = np.zeros((0, 3), np.int64)
    if not any(len(d) for d in docs):
        return [none] * len(docs)
    found, bounds, at, size = roots(docs)
    right = found.common_prefix(at, at + size)
    far = right >= max(exponent - 2, 0) * size
    at, size, right = at[far], size[far], right[far]
    doc = np.searchsorted(bounds, at, side="right") - 1
    out = [none] * len(docs)
    some = np.unique(doc)
    if not len(some):
        return out
    # The same on reversed words, of these documents only.
    back, turned = closed([docs[i][::-1] for i in some.tolist()])
    behind = Matches(back)
    which = np.searchsorted(some, doc)
    mirror = turned[which + 1] - 2 - (at - bounds[doc])  # the place of the word at ``at``
    left = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > bounds[doc])
    left[inner] = behind.common_prefix(mirror[inner] + 1, mirror[inner] + 1 - size[inner])
    length = size + left + right
    ok = (length >= 2 * size) & (length >= np.maximum(least, exponent * size))
    rows = np.unique(np.column_stack([doc, at - left - bounds[doc], size, length])[ok], axis=0)
    cut = np.searchsorted(rows[:, 0], np.arange(len(docs) + 1))
    for i in some.tolist():
        out[i] = rows[cut[i] : cut[i + 1]][:, [1, 3, 2]]
    return out


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """Per document: ``doc_id, n_words, runs`` (start, length and smallest period in words, by start and period; ``exponent`` periods and ``least`` words at
    least) and ``kept``: the words, joined by a space, without those that a run holds after its first period."""
    if exponent < 2 or least < 1:
        raise ValueError("exponent >= 2 and least >= 1 must hold")
    P.arrow_limits(docs.sparkSession)

    def find(ids: list, texts: list) -> pa.Table:
        words = [(t or "").encode().split() for t in texts]
        numbers: dict[bytes, int] = {}
        coded = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in d), np.int64, len(d)) for d in words]
        kept, spans, ends = [], [], [0]
        for d, rows in zip(words, runs_of(coded, least, exponent), strict=True):
            spans.append(rows)
            ends.append(ends[-1] + len(rows))
            if len(rows):
                step = np.zeros(len(d) + 1, np.int32)
                np.add.at(step, rows[:, 0] + rows[:, 2], 1)
                np.subtract.at(step, rows[:, 0] + rows[:, 1], 1)
                gone = np.cumsum(step[:-1]) > 0
                d = [w for w, g in zip(d, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(d))
        flat = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(d) for d in words], pa.int64()), "runs": runs, "kept": pa.array(kept, pa.binary())}).cast(OUT)

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i), texts.append(t)
                size += len(t or "") // 6 + 1
                if size >= CHUNK:
                    yield from find(ids, texts).to_batches()
                    ids, texts, size = [], [], 0
        if ids:
            yield from find(ids, texts).to_batches()
        P.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def repeating(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document (by the checksum of its id) goes on in a period; a null id leaves the text as it is."""
    P.arrow_limits(docs.sparkSession)

    def text_of(i, text):
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not (words := (text or "").encode().split()):
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([text_of(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    done = periodic_runs(repeating(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    done = done.withColumn("best", best)
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


# Checksums byte by byte from the table of 256; runs as islands of equal words at each distance, those that a smaller period explains taken out.
ORACLE = r"""
WITH RECURSIVE poly(i, k, x) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM poly WHERE k < 8),
tab AS MATERIALIZED (SELECT i, x FROM poly WHERE k = 8),
crc(doc_id, s, k, x) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM documents UNION ALL
  SELECT c.doc_id, c.s, c.k + 1, xor(c.x >> 8, t.x) FROM crc c JOIN tab t ON t.i = xor(c.x & 255, ascii(c.s[c.k])::BIGINT) WHERE c.k <= length(c.s)),
h AS (SELECT doc_id, xor(x, 4294967295) AS h FROM crc WHERE k = length(s) + 1),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT d.doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS turned, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM d JOIN h USING (doc_id)),
w AS MATERIALIZED (SELECT doc_id, i, ws[1 + CASE WHEN turned AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i JOIN n ON n.doc_id = x.doc_id WHERE 4 * (y.i - x.i) <= n.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island HAVING count(*) >= greatest(6 - q, 3 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id),
o AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'q': q}, {'l': length, 's': -start, 'q': -q}) AS b, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
