"""Lines repeated across documents, by levelled sorted runs of line hashes.

Method. Each pack of documents is a batch with a sorted run of its distinct line keys (128-bit hashes under a key) and, for each, the
number of its documents that hold it and the largest ``doc_id`` among them. In each bucket of the hash space the batches
merge-anti-join the runs of a family (:mod:`._runs`): a key that a run holds adds to its counts, the rest form a new run, and
runs of one level are compacted into the next. After the last batch each pack hears of its frequent keys only. With a :class:`LineIndex` the runs are
kept in a table (:mod:`._levels`), so that a later batch is judged in the light of all earlier ones.

Rows: every input row gives one row. Null text counts as one empty line (and stays null where the columns are carried
through); a null ``doc_id`` counts as smaller than any other; rows that repeat a ``doc_id`` are separate documents, and if it is the
largest both keep the line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _packs as P
from . import _prints as R
from ._levels import Levels
from ._runs import Family
from ._session import checkpoints

SPACE = b" \t\n\x0b\x0c\r"
OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
SCHEMA = "doc_id long, text string, n_lines long, n_dropped long"
KEY = np.dtype("S16")  # 128 bits; compares as a whole, zeros at the end included
LEAST_ID = np.iinfo(np.int64).min


def keys_of(table: pa.Table, least: int, seed: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Each document's lines; and the hash, document number and line number of every line whose key is long enough."""
    data, offsets = P.texts(table)
    whole, docs, h, d, n = data.tobytes(), [], [], [], []
    digest = xxhash.xxh3_128_digest
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = whole[a:b].split(b"\n")
        docs.append(lines)
        for j, line in enumerate(lines):
            if len(line) >= least:
                key = line.strip(SPACE).lower()  # of bytes: A-Z only
                if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                    h.append(digest(key, seed)), d.append(i), n.append(j)
    return docs, np.array(h, KEY), np.array(d, np.int64), np.array(n, np.int64)


def distinct(h: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pack's run: sorted keys, the documents that hold each, and the largest id among them."""
    if not len(h):
        return h, d, d
    o = np.lexsort((d, h))
    h, d = h[o], d[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    h, i = h[new], ids[d[new]]
    where = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[where], np.diff(np.r_[where, len(h)]), np.maximum.reduceat(i, where)


def front(key: np.ndarray) -> np.ndarray:
    """The first eight bytes as numbers, in the order of the keys."""
    return np.frombuffer(key.tobytes(), ">u8")[::2].astype(np.uint64)


def run_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, largest ids and counts of a run."""
    m = len(blob) // 28
    return np.frombuffer(blob, KEY, m), np.frombuffer(blob, np.int64, m, 16 * m), np.frombuffer(blob, np.int32, m, 24 * m).astype(np.int64)


def blob_of(key: np.ndarray, largest: np.ndarray, count: np.ndarray) -> bytes:
    return key.astype(KEY).tobytes() + largest.tobytes() + np.minimum(count, 2**31 - 1).astype(np.int32).tobytes()


def fold(held, at, new):
    held[0][at] = np.maximum(held[0][at], new[0])
    held[1][at] += new[1]


def compacted(blobs: list[bytes]) -> bytes:
    runs = Family(fold)
    for blob in blobs:
        runs.add(*run_of(blob))
    key, columns = runs.whole()
    return blob_of(key, *columns) if columns else b""


class LineIndex:
    """The runs of all batches so far, in a folder that all executors share."""

    def __init__(self, spark, root: str, buckets: int = 64):
        self.levels = Levels(spark, root, buckets, compacted)

    def add(self, docs: DataFrame, **options) -> DataFrame:
        """:func:`line_dedup` of a batch, where the documents of earlier batches count as well; these stay as they were. A repeated batch counts twice."""
        return line_dedup(docs, index=self, **options)


def line_dedup(docs: DataFrame, least: int = 20, copies: int = 3, carry: bool = False, index: LineIndex | None = None) -> DataFrame:
    """Drop lines whose key has ``least`` code points and stands in ``copies`` documents, but for the largest ``doc_id``.

    Returns ``doc_id, text, n_lines, n_dropped``, or with ``carry`` the columns of ``docs`` with ``text`` replaced.
    """
    if not carry:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = index.levels.buckets if index else P.bucket_count(P.text_bytes(docs) / 3)  # lines of 80 bytes and more, 28 bytes each; more buckets do no harm
    packs, seed = P.packed(docs), index.levels.key if index else R.new_key()
    schema, out = (docs.schema.simpleString()[7:-1], to_arrow_schema(docs.schema)) if carry else (SCHEMA, OUT)

    def ask(pack, table):
        _, h, d, _ = keys_of(table, least, seed)
        key, count, largest = distinct(h, d, P.doc_ids(table, LEAST_ID))
        for b, s in P.slices(front(key), n).items():
            yield b, blob_of(key[s], largest[s], count[s])

    lasting = index is not None

    def answer(bucket, rows):
        runs, own, batches = Family(fold), Family(fold), []
        for pack, blob in rows:  # runs of earlier batches stand first
            run = run_of(blob)
            runs.add(*run)
            if pack >= 0:
                batches.append((pack, run[0]))
                if lasting:
                    own.add(*run)
        for pack, key in batches:
            hot = key[runs.find(key, 1, 0) >= copies]
            if len(hot):
                yield pack, hot.tobytes() + runs.find(hot, 0, LEAST_ID).tobytes()
        key, columns = own.whole()
        if columns:
            yield -1, blob_of(key, *columns)

    def drop(pack, table, told):
        lines, h, d, j = keys_of(table, least, seed)
        ids = P.doc_ids(table, LEAST_ID)
        parts = [(np.frombuffer(x, KEY, len(x) // 24), np.frombuffer(x, np.int64, len(x) // 24, len(x) // 24 * 16)) for _, x in sorted(told[0].items())]
        key, keeper = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, KEY), np.zeros(0, np.int64))
        gone: dict[int, set[int]] = {}
        if len(key) and len(h):
            at = np.searchsorted(key, h)
            at[at == len(key)] = 0
            for i, x in zip(*(v[(key[at] == h) & (keeper[at] != ids[d])].tolist() for v in (d, j)), strict=True):
                gone.setdefault(i, set()).add(x)
        text = [b"\n".join(x if i not in gone else [y for k, y in enumerate(x) if k not in gone[i]]) for i, x in enumerate(lines)]
        text = pa.array(text, pa.binary()).cast(pa.string())
        if carry:
            at = table.schema.get_field_index("text")
            return table.set_column(at, "text", pa.compute.if_else(table.column("text").combine_chunks().is_null(), None, text))
        return pa.table({"doc_id": table.column("doc_id"), "text": text, "n_lines": [len(x) for x in lines], "n_dropped": [len(gone.get(i, ())) for i in range(len(lines))]}, schema=OUT)

    questions = P.ask(packs, ask)
    if index is None:
        return P.apply(packs, [P.answer(questions, answer)], drop, schema, out)
    checkpoints(docs.sparkSession)
    answers = P.answer(questions.unionAll(index.levels.held()), answer).checkpoint()
    index.levels.add(answers.where("pack < 0"))
    return P.apply(packs, [answers.where("pack >= 0")], drop, schema, out)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# The line key by regular expression (the class is the six separators), hashed as UTF-8 by sha256.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(hot.k) FILTER (hot.keeper <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (hot.k IS NULL OR hot.keeper = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k GROUP BY l.doc_id
"""
