"""Substrings of at least 400 bytes that occur twice, found by a logarithmic family of sparse suffix arrays.

Method. A batch of documents gets a sparse suffix array: instead of every suffix it holds one per *anchor* (the least 64-byte gram of a
256-byte window), about one in 80 bytes, which is enough, since equal windows have equal anchors at equal distances. All windows of an anchor make
a *stretch*. Two rounds decide every window exactly:

1. by anchor: suffixes with one anchor meet in a bucket. A stretch that occurs twice is repeated as a whole, a single anchor has no
   repeated window, and anchors that stand in different stretches stay open. In each bucket every pack is a new batch: its run, sorted by anchor and stretch,
   is merge-scanned against the levels of a family (:mod:`._runs`) of the packs before it, where a stretch that a level holds is a long match; what none holds
   becomes a run, and runs of one level merge into the next;
2. by suffix: one copy of each open stretch goes to a bucket as text. The suffixes from the anchors on, and the texts before them, are sorted
   (:mod:`._suffixes`), and the common prefixes of neighbours give the classes of equal windows. An anchor that stands in more than
   ``HOT`` different stretches could fill a bucket by itself; its windows are dealt out one by one instead, by 128-bit hashes.

Copies are folded inside each pack first, so a passage held by a third of all documents costs each pack one entry. Stretches are told apart by keyed 128-bit
hashes of their bytes, windows of open stretches by their bytes.

:class:`SuffixIndex` keeps the family on disk (:mod:`._levels`): a new batch is merge-scanned against every level, packs of earlier batches speak for the
open stretches that it meets, what no level holds becomes a level itself, and equal levels merge. Without one the family lives in the buckets of the job.

Rows: every input row gives one row; null or empty text gives no spans; repeated ``doc_id`` values are separate documents;
texts under the window length are kept whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packs as P
from . import _prints as R
from ._levels import Levels
from ._runs import Family
from ._session import checkpoints
from ._suffixes import SuffixArray, columns, equal_windows

#: Of a stretch: it occurs twice; its anchor stands in others, too; this pack speaks for it; two documents hold it; its anchor is in over ``HOT``.
DUP, OPEN, FIRST, SHARED, MANY = 1, 2, 4, 8, 16
#: Different stretches of an anchor that are compared in one task.
HOT = 1024
GRAM = 64
#: An entry's key: eight bytes of the anchor's print (the higher first), then the stretch's digest.
KEY = np.dtype("S24")
#: Pack numbers of a batch begin at its number shifted by this; below are the partition and the place in it.
BATCH = 50
#: Shared passages are reported from this length on (some 40 words).
LEAST = 256
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("longest_shared", pa.int64()), ("kept", pa.binary())])
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, longest_shared long, kept binary"


class Batch:
    """A pack's sparse suffix array: its distinct (anchor, stretch) entries, and where they stand."""

    def __init__(self, table: pa.Table, window: int, least: int, secret: int):
        self.window, self.least, self.secret = window, least, secret
        self.data, self.offsets = P.texts(table)
        self.text, found = self.data.tobytes(), []
        for a, b in P.chunks(self.offsets):
            at = self.offsets[a : b + 1] - self.offsets[a]
            gram = R.byte_grams(self.data[self.offsets[a] : self.offsets[b]], GRAM)
            first, last, anchor = R.anchored(gram, GRAM, at, least)
            doc = np.searchsorted(at, first, side="right") - 1
            end = np.minimum(last + window, at[doc + 1])
            base = self.offsets[a]
            found.append((first + base, last + base, anchor + base, end + base, doc + a, gram[anchor]))
        none = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, R.U)]
        self.first, self.last, self.at, self.end, self.doc, anchor = map(np.concatenate, zip(*found, strict=True)) if found else none
        # Least grams crowd at the low end of the range that buckets cut; joined once more they fill it.
        anchor = R.join(anchor, np.ones_like(anchor))
        stretch = R.digests(self.text, self.first, self.end, secret)
        order = np.lexsort((stretch[:, 1], stretch[:, 0], anchor))
        k, doc = np.column_stack([anchor, stretch])[order], self.doc[order]
        new = np.r_[True, (k[1:] != k[:-1]).any(1)] if len(k) else np.zeros(0, bool)
        where = np.flatnonzero(new)
        self.anchor, self.some = k[where, 0], order[where]
        self.key = np.frombuffer(k[where].astype(">u8").tobytes(), KEY)
        self.flags = np.zeros(len(where), np.uint8)
        if len(where):
            self.flags |= DUP * (np.diff(np.r_[where, len(k)]) > 1).astype(np.uint8)
            self.flags |= SHARED * (np.minimum.reduceat(doc, where) != np.maximum.reduceat(doc, where)).astype(np.uint8)
        self.entry = np.empty(len(k), np.int64)  # of each occurrence
        self.entry[order] = np.cumsum(new) - 1

    def ask(self, n: int):
        for b, s in P.slices(self.anchor, n).items():
            yield b, self.key[s].tobytes() + self.flags[s].tobytes()

    def told(self, replies: dict[int, bytes], n: int) -> np.ndarray:
        at, out = P.slices(self.anchor, n), np.zeros(len(self.anchor), np.uint8)
        for b, x in replies.items():
            out[at[b]] = np.frombuffer(x, np.uint8)
        return out

    def spoken(self, replies: dict[int, bytes]) -> np.ndarray:
        """Flags of the entries that a later batch asks this pack to speak for."""
        out = np.zeros(len(self.anchor), np.uint8)
        for x in replies.values():
            n = len(x) // 25
            out[np.searchsorted(self.key, np.frombuffer(x, KEY, n))] = np.frombuffer(x, np.uint8, n, 24 * n)
        return out

    def open(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The open entries that this pack speaks for: those to compare as text, and those of hot anchors."""
        mine = (flags & (OPEN | FIRST)) == OPEN | FIRST
        return np.flatnonzero(mine & ((flags & MANY) == 0)), np.flatnonzero(mine & ((flags & MANY) > 0))

    def ask_text(self, entries: np.ndarray, flags: np.ndarray, n: int):
        x = self.some[entries]
        size = self.end[x] - self.first[x]
        head = [self.anchor[entries], size.astype(np.uint16), (self.at - self.first)[x].astype(np.uint16), (self.at - self.last)[x].astype(np.uint16), self.doc[x].astype(np.uint32), flags[entries]]
        for b, s in P.slices(self.anchor[entries], n).items():
            own = x[s]
            yield b, b"".join([np.uint32(len(own)).tobytes(), *[h[s].tobytes() for h in head], self.data[R.ranges(self.first[own], self.end[own])].tobytes()])

    def windows(self, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of ``size`` bytes of some entries: the halves of its digest, its start and its entry (a place in ``entries``)."""
        x = self.some[entries]
        a = self.first[x]
        b = np.maximum(a, np.minimum(self.last[x], self.end[x] - size) + 1)
        p = R.ranges(a, b)
        print_ = R.digests(self.text, p, p + size, self.secret)
        return print_[:, 0], print_[:, 1], p, np.repeat(np.arange(len(x)), b - a)

    def hot(self, entries: np.ndarray, flags: np.ndarray):
        """For each length: the distinct windows of hot anchors, as digests and flags; and of each window its place there and its start."""
        for size in (self.window, self.least):
            a, b, p, e = self.windows(entries, size)
            order = np.lexsort((b, a))
            a, b, doc, own = a[order], b[order], self.doc[self.some[entries]][e[order]], flags[entries][e[order]]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            where, place = np.flatnonzero(new), np.empty(len(a), np.int64)
            place[order] = np.cumsum(new) - 1
            told = np.zeros(len(where), np.uint8)
            if len(where):
                told |= np.bitwise_or.reduceat(own, where) & (DUP | SHARED)
                told |= DUP * (np.diff(np.r_[where, len(a)]) > 1).astype(np.uint8)
                told |= SHARED * (np.minimum.reduceat(doc, where) != np.maximum.reduceat(doc, where)).astype(np.uint8)
            yield a[where], b[where], told, place, p


RUN_ENTRY = 33  # bytes: key, the pack that speaks for it, flags


def entries(blob: bytes, pack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, flags and speakers of a pack's question, or (packs below 0) of a run."""
    n = len(blob) // (25 if pack >= 0 else RUN_ENTRY)
    speaker = np.full(n, pack) if pack >= 0 else np.frombuffer(blob, np.int64, n, 24 * n)
    return np.frombuffer(blob, KEY, n), np.frombuffer(blob, np.uint8, n, (24 if pack >= 0 else 32) * n), speaker


def meet(held, at, new):
    """A long match: what a level holds stands in a new batch as well, so in two documents. The one who spoke first goes on to speak."""
    held[0][at] |= new[0] & (DUP | SHARED) | DUP | SHARED


def run_of(key: np.ndarray, flags: np.ndarray, speaker: np.ndarray) -> bytes:
    return key.astype(KEY).tobytes() + speaker.astype(np.int64).tobytes() + flags.astype(np.uint8).tobytes()


def merged_runs(blobs: list[bytes]) -> bytes:
    """One sorted run; no entry is in two."""
    family = Family(meet)
    for blob in blobs:
        family.add(*entries(blob, -1))
    key, columns = family.whole()
    return run_of(key, *columns) if columns else b""


def answer_anchors(rows: list[tuple[int, bytes]], most: int, batch: int | None = None) -> list[tuple[int, bytes]]:
    """Flags for every entry. For a ``batch`` of an index, also the entries that packs of earlier batches must speak for, and (for pack -1) the batch's run."""
    family, asked = Family(meet), []
    for pack, blob in rows:
        key, flags, speaker = entries(blob, pack)
        family.add(key, flags, speaker)
        if pack >= 0:
            asked.append((pack, key))
    key, columns = family.whole()
    if not columns or not asked:
        return []
    both, speaker = columns
    anchor = np.frombuffer(key.tobytes(), R.U)[::3]
    head = np.r_[True, anchor[1:] != anchor[:-1]]
    group = np.cumsum(head) - 1
    n = np.bincount(group)[group]  # different stretches of the anchor
    told = both | OPEN * (n > 1).astype(np.uint8) | MANY * (n > most).astype(np.uint8)
    out, met = [], np.zeros(len(key), bool)
    for pack, own in asked:
        at = np.searchsorted(key, own)
        met[at] = True
        out.append((pack, (told[at] | FIRST * (speaker[at] == pack).astype(np.uint8)).tobytes()))
    if batch is not None:
        fresh = speaker >= batch << BATCH
        speak = np.flatnonzero(~fresh & (np.bincount(group, met) > 0)[group] & ((told & OPEN) > 0))
        for p in np.unique(speaker[speak]).tolist():
            own = speak[speaker[speak] == p]
            out.append((p, key[own].tobytes() + (told[own] | FIRST).tobytes()))
        out.append((-1, run_of(key[fresh], both[fresh], speaker[fresh])))
    return out


def folded(rows: list[tuple[int, bytes]]):
    """All windows ``(key, key, flags)`` of some packs in the order of their keys: flags, which row they came from, which are new, and the order."""
    k, r, f, src = [np.zeros(0, R.U)], [np.zeros(0, R.U)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for i, (_, blob) in enumerate(rows):
        n = len(blob) // 17
        k.append(np.frombuffer(blob, R.U, n)), r.append(np.frombuffer(blob, R.U, n, 8 * n)), f.append(np.frombuffer(blob, np.uint8, n, 16 * n)), src.append(np.full(n, i))
    k, r, f, src = map(np.concatenate, (k, r, f, src))
    order = np.lexsort((r, k))
    k, r, f, src = k[order], r[order], f[order], src[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])] if len(k) else np.zeros(0, bool)
    where = np.flatnonzero(new)
    both = np.bitwise_or.reduceat(f, where) if len(where) else f
    several = np.diff(np.r_[where, len(k)]) > 1  # in two packs, so in two documents
    return both & (DUP | SHARED) | (DUP | SHARED) * several.astype(np.uint8), src, new, order


def answer_hot(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    both, src, new, order = folded(rows)
    out = np.empty(len(order), np.uint8)
    out[order] = both[np.cumsum(new) - 1]
    ends = np.cumsum(np.bincount(src, minlength=len(rows)))
    return [(pack, out[a:b].tobytes()) for (pack, _), a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def answer_text(rows: list[tuple[int, bytes]], window: int, least: int) -> list[tuple[int, bytes]]:
    """For each entry, bits for its windows in order of their starts: those of ``window`` bytes that occur twice, then those of ``least`` that two documents hold."""
    parts, texts, counts = [], [], []
    for i, (_, blob) in enumerate(rows):
        n, at, own = int(np.frombuffer(blob, np.uint32, 1)[0]), 4, []
        for kind in (R.U, np.uint16, np.uint16, np.uint16, np.uint32, np.uint8):
            own.append(np.frombuffer(blob, kind, n, at))
            at += n * own[-1].itemsize
        parts.append([*own, np.full(n, i, np.int64)]), texts.append(np.frombuffer(blob, np.uint8, -1, at)), counts.append(n)
    anchor, size, high, low, doc, flags, src = map(np.concatenate, zip(*parts, strict=True))
    size, high, low, doc = size.astype(np.int64), high.astype(np.int64), low.astype(np.int64), src << 32 | doc.astype(np.int64)
    data, end = np.concatenate(texts), np.cumsum(size)
    start, n = end - size, len(size)
    left = SuffixArray(anchor, columns(data, start, start + high, backwards=True), 8)
    right = SuffixArray(anchor, columns(data, start + high, end), 8)
    many = high - low + 1
    at = np.cumsum(many) - many
    dup, shared = np.zeros(int(many.sum()), bool), np.zeros(int(many.sum()), bool)
    for o, rows_, number in equal_windows(left, right, low, high, size - high, window):
        count = np.bincount(number, 1 + (flags[rows_] & DUP))
        dup[at[rows_] + high[rows_] - o] = count[number] > 1
    for o, rows_, number in equal_windows(left, right, low, high, size - high, least):
        some, most = np.full(number.max() + 1, np.iinfo(np.int64).max), np.full(number.max() + 1, -1)
        np.minimum.at(some, number, doc[rows_]), np.maximum.at(most, number, doc[rows_])
        two = some != most
        two[number[(flags[rows_] & SHARED) > 0]] = True
        shared[at[rows_] + high[rows_] - o] = two[number]
    out, ends = [], np.cumsum(counts)
    cut = np.r_[at, len(dup)]
    for (pack, _), a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        out.append((pack, np.packbits(dup[cut[a] : cut[b]]).tobytes() + np.packbits(shared[cut[a] : cut[b]]).tobytes()))
    return out


class SuffixIndex:
    """The family of all batches so far, and their packs, in a folder that all executors share."""

    def __init__(self, spark, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.levels = Levels(spark, f"{self.root}/levels", buckets, merged_runs)

    def add(self, docs: DataFrame, **options) -> DataFrame:
        """:func:`suffix_dedup` of a batch, where strings of earlier batches count as well; these stay as they were."""
        return suffix_dedup(docs, index=self, **options)

    def packs(self, batch: int) -> DataFrame:
        return self.spark.read.schema("pack long, body binary").parquet(f"{self.root}/packs-{batch}")


def suffix_dedup(docs: DataFrame, window: int = 400, least: int = LEAST, most: int = HOT, index: SuffixIndex | None = None) -> DataFrame:
    """Per document: ``doc_id, n_bytes, spans`` (the maximal removed byte ranges), ``longest_shared`` (the length of the longest stretch whose strings
    of ``least`` bytes all stand in other documents as well; 0 without one) and ``kept`` (the bytes that remain)."""
    if not GRAM <= least <= window < 1 << 15:
        raise ValueError(f"{GRAM} <= least <= window must hold")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = P.text_bytes(docs)
    # An entry of 25 bytes for some 80; open stretches make up to six times the text, but most stretches are not open; hot windows are rarer still.
    n1, n2, n3 = P.bucket_count(total * 25 / 80), P.bucket_count(total), P.bucket_count(total)
    packs, batch, secret = P.packed(docs), 0, R.new_key()
    if index is not None:
        n1, batch, secret = index.levels.buckets, index.levels.batches, index.levels.key
        packs.withColumn("pack", F.col("pack") + (batch << BATCH)).write.mode("overwrite").parquet(f"{index.root}/packs-{batch}")
        packs = index.packs(batch)

    def ask_anchors(pack, table):
        yield from Batch(table, window, least, secret).ask(n1)

    def ask_open(pack, table, told):
        x = Batch(table, window, least, secret)
        flags = x.told(told, n1) if pack >> BATCH == batch else x.spoken(told)
        text, many = x.open(flags)
        yield from x.ask_text(text, flags, n2)
        for i, (a, b, f, _, _) in enumerate(x.hot(many, flags)):
            for k, s in P.slices(a, n3).items():
                yield n2 + i * n3 + k, a[s].tobytes() + b[s].tobytes() + f[s].tobytes()

    def answer_open(bucket, rows):
        return answer_text(rows, window, least) if bucket < n2 else answer_hot(rows)

    def cut(pack, table, told):
        x = Batch(table, window, least, secret)
        flags = x.told(told[0], n1)
        of = flags[x.entry]
        text, many = x.open(flags)
        dup, shared = np.zeros(len(x.data), bool), np.zeros(len(x.data), bool)  # of starts
        whole = np.flatnonzero(of & DUP)
        dup[R.ranges(x.first[whole], np.maximum(x.first[whole], np.minimum(x.last[whole], x.end[whole] - window) + 1))] = True
        whole = np.flatnonzero(of & SHARED)
        shared[R.ranges(x.first[whole], x.last[whole] + 1)] = True
        for b, s in P.slices(x.anchor[text], n2).items():
            own = x.some[text[s]]
            p = R.ranges(x.first[own], x.last[own] + 1)
            bits = np.unpackbits(np.frombuffer(told[1][b], np.uint8).reshape(2, -1), axis=1, count=len(p)).astype(bool)
            dup[p[bits[0]]] = True
            shared[p[bits[1]]] = True
        for i, (a, _, f, place, p) in enumerate(x.hot(many, flags)):
            for b, s in P.slices(a, n3).items():
                f[s] = np.frombuffer(told[1][n2 + i * n3 + b], np.uint8)
            [dup, shared][i][p[(f[place] & [DUP, SHARED][i]) > 0]] = True
        gone = R.covered(np.flatnonzero(dup), window, len(x.data))
        spans, ends, kept, longest = [], [0], [], []
        for a, b in zip(x.offsets[:-1], x.offsets[1:], strict=True):
            g = gone[a:b]
            if g.any():
                edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                spans.append(edge)
                kept.append(x.data[a:b][~g].tobytes())
                ends.append(ends[-1] + len(edge) // 2)
            else:
                kept.append(x.data[a:b].tobytes())
                ends.append(ends[-1])
            edge = np.flatnonzero(np.diff(np.r_[False, shared[a:b], False]))
            longest.append(int((edge[1::2] - edge[0::2]).max()) + least - 1 if len(edge) else 0)
        edge = np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(edge[0::2]), pa.array(edge[1::2])], ["start", "end"])
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(x.offsets)), "spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), "longest_shared": pa.array(longest, pa.int64()), "kept": pa.array(kept, pa.binary())})

    questions = P.ask(packs, ask_anchors)
    if index is None:
        anchors = P.answer(questions, lambda bucket, rows: answer_anchors(rows, most))
        opened = P.answer(P.ask_again(packs, anchors, ask_open), answer_open)
        return P.apply(packs, [anchors, opened], cut, SCHEMA, OUT)
    checkpoints(docs.sparkSession)
    anchors = P.answer(questions.unionAll(index.levels.held()), lambda bucket, rows: answer_anchors(rows, most, batch)).checkpoint()
    speakers, asked = packs, anchors.where("pack >= 0")
    for earlier in range(batch):
        speakers = speakers.unionAll(index.packs(earlier).join(asked.select("pack").distinct(), "pack", "left_semi"))
    opened = P.answer(P.ask_again(speakers, asked, ask_open), answer_open).checkpoint()
    index.levels.add(anchors.where("pack = -1"))
    mine = F.shiftright("pack", BATCH) == batch
    return P.apply(packs, [asked.where(mine), opened.where(mine)], cut, SCHEMA, OUT)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns ``longest_shared``: passages of over 50 words can be shorter than the 400 bytes that are removed."""
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_shared",
    )


# Every window of 400 bytes (in hex) and, for what other documents share, of 256.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, c, substring(x, 2048 * c + 1, 2848) AS y FROM (SELECT *, unnest(range(0, (n + 1023) // 1024)) AS c FROM d)), -- pieces of 1024 bytes and what windows reach beyond
p AS (SELECT doc_id, n, y, c, unnest(range(1, least(1024, n - 1024 * c) + 1)) AS j FROM c),
w AS MATERIALIZED (SELECT doc_id, 1024 * c + j AS i, substring(y, 2 * j - 1, 2) AS b, CASE WHEN 1024 * c + j + 399 <= n THEN md5_number(substring(y, 2 * j - 1, 800)) END AS h, CASE WHEN 1024 * c + j + 255 <= n THEN md5_number(substring(y, 2 * j - 1, 512)) END AS g FROM p),
twice AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
shared AS (SELECT g FROM w WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) <> max(doc_id)),
t AS (SELECT doc_id, i, b, max(CASE WHEN twice.h IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN twice ON twice.h = w.h),
u AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM t),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM u GROUP BY doc_id),
l AS (SELECT doc_id, max(n) + 255 AS longest_shared FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w JOIN shared ON shared.g = w.g) GROUP BY doc_id, run) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(longest_shared, 0)::BIGINT AS longest_shared
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
"""
