"""Repeated 13-word windows, by relative Lempel-Ziv parsing against all earlier documents.

Method. Each pack of documents is a reference block. Its index holds an entry for each *phrase*: the run of windows that share an anchor (the least
5-word gram of a window), with the smallest ``doc_id`` that holds it. A factor can only begin where a reference block has the same
anchor, so buckets of anchors hold the indexes of all blocks, and a document is parsed against every one at once:

1. greedy step: a phrase that an earlier document holds whole is copied whole, the longest factor that its anchor allows;
2. factor boundaries: a phrase that shares its anchor with others, but that no earlier document holds whole, is where factors begin and end. One copy of it
   goes to a bucket as text, is compared word by word with the reference texts on both sides of the anchor (sorted, see :mod:`._suffixes`), and every
   start from which a reference of an earlier document matches 13 words and more is part of a factor. Anchors in more than ``HOT`` different
   phrases could fill a bucket; their windows are dealt out one by one, by 128-bit hashes.

Factors, joined and overlapping, make the duplicate spans. Whole phrases are the same if keyed 128-bit hashes of their words are; in
open ones words are compared as bytes. Copies fold inside each block before they are sent.

Rows: every input row gives one row; null text has no words; a null ``doc_id`` is neither smaller nor larger than another, so such
a document keeps its words and takes none from others; rows that share an id take nothing from each other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packs as P
from . import _prints as R
from ._suffixes import SuffixArray, columns, equal_windows

#: Of a phrase: its anchor stands in others, too; this pack holds it in a document with the least id; its anchor is in over ``HOT``.
OPEN, FIRST, MANY = 1, 2, 4
#: Different phrases of an anchor that are compared in one task.
HOT = 4096
NO_ID = np.iinfo(np.int64).max
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
SCHEMA = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept binary"


class Block:
    """A pack's phrases: distinct (anchor, phrase) entries with their first holder, and where phrases stand."""

    def __init__(self, table: pa.Table, window: int, gram: int, secret: int):
        self.window, self.secret, self.ids = window, secret, P.doc_ids(table, NO_ID)
        self.data, self.offsets = P.texts(table)
        prints, starts, ends, bounds, total = [np.zeros(0, R.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        for a, b in P.chunks(self.offsets):
            at = self.offsets[a : b + 1] - self.offsets[a]
            part = self.data[self.offsets[a] : self.offsets[b]]
            start, end, first = R.words(part, at)
            prints.append(R.spans(R.Eights(part), start, end))
            starts.append(start + self.offsets[a]), ends.append(end + self.offsets[a]), bounds.append(first[1:] + total)
            total += len(start)
        word = np.concatenate(prints)
        self.start, self.end, self.bounds = np.concatenate(starts), np.concatenate(ends), np.concatenate(bounds)
        short = R.grams(word, gram)  # chooses anchors, decides nothing
        text = self.data.tobytes()
        self.plain = b" ".join(w for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True) if (w := b" ".join(text[a:b].split())))
        self.stop = np.cumsum(self.end - self.start + 1) - 1  # where words end in it
        self.first, self.last, self.at = R.anchored(short, gram, self.bounds, window)
        self.doc = np.searchsorted(self.bounds, self.first, side="right") - 1
        anchor = R.join(short[self.at], np.ones(len(self.at), R.U))
        phrase = self.digests(self.first, self.last + window)
        holder = self.ids[self.doc]
        order = np.lexsort((holder, phrase[:, 1], phrase[:, 0], anchor))
        k = np.column_stack([anchor, phrase])[order]
        new = np.r_[True, (k[1:] != k[:-1]).any(1)] if len(k) else np.zeros(0, bool)
        where = np.flatnonzero(new)
        self.anchor, self.phrase, self.some, self.holder = k[where, 0], k[where, 1:], order[where], holder[order[where]]
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words ``[first, end)``, joined by a space."""
        size = self.end - self.start
        return R.digests(self.plain, self.stop[first] - size[first], self.stop[end - 1], self.secret)

    def told(self, replies: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: its first holder in all documents, and the flags."""
        first, flags = self.holder.copy(), np.zeros(len(self.anchor), np.uint8)
        for b, s in P.slices(self.anchor, n).items():
            m = s.stop - s.start
            flags[s] = np.frombuffer(replies[b], np.uint8, m)
            earlier = np.flatnonzero((flags[s] & FIRST) == 0) + s.start
            first[earlier] = np.frombuffer(replies[b], np.int64, -1, m)
        return first, flags

    def open(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = ((flags & (OPEN | FIRST)) == OPEN | FIRST) & (self.holder != NO_ID)
        return np.flatnonzero(mine & ((flags & MANY) == 0)), np.flatnonzero(mine & ((flags & MANY) > 0))

    def ask_text(self, entries: np.ndarray, n: int):
        x = self.some[entries]
        a, b = self.start[self.first[x]], self.end[self.last[x] + self.window - 1]
        head = [self.anchor[entries], self.holder[entries], (b - a).astype(np.uint32), (self.at - self.first)[x].astype(np.uint8), (self.at - self.last)[x].astype(np.uint8)]
        for k, s in P.slices(self.anchor[entries], n).items():
            yield k, b"".join([np.uint32(s.stop - s.start).tobytes(), *[h[s].tobytes() for h in head], self.data[R.ranges(a[s], b[s])].tobytes()])

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of some entries: the halves of the digest and the least id of each; and of each window its place there and its start."""
        x = self.some[entries]
        p = R.ranges(self.first[x], self.last[x] + 1)
        ids = np.repeat(self.holder[entries], (self.last - self.first)[x] + 1)
        a, b = self.digests(p, p + self.window).T
        order = np.lexsort((ids, b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], b[new], ids[order[new]], place, p


def gathered(rows: list[tuple[int, bytes]], m: int):
    """All entries (``m`` columns of a key, then an id) of some packs in their order: the first column, ids, which row they came from, which are new, and the order."""
    parts, src = [np.zeros((m + 1, 0), R.U)], [np.zeros(0, np.int64)]
    for i, (_, blob) in enumerate(rows):
        parts.append(np.frombuffer(blob, R.U).reshape(m + 1, -1))
        src.append(np.full(parts[-1].shape[1], i))
    table, src = np.concatenate(parts, axis=1), np.concatenate(src)
    order = np.lexsort((table[m].view(np.int64), *table[:m][::-1]))
    table = table[:, order]
    new = np.r_[True, (table[:m, 1:] != table[:m, :-1]).any(0)] if len(order) else np.zeros(0, bool)
    return table[0], table[m].view(np.int64), src[order], new, order


def answer_phrases(rows: list[tuple[int, bytes]], most: int) -> list[tuple[int, bytes]]:
    """Flags of each entry, and the least id of all holders for those whose pack has no document with it."""
    k, d, src, new, order = gathered(rows, 3)
    if not len(k):
        return []
    where, group = np.flatnonzero(new), np.cumsum(new) - 1
    head = np.r_[True, k[where][1:] != k[where][:-1]]
    n = np.diff(np.r_[np.flatnonzero(head), len(where)])[np.cumsum(head) - 1]
    least = d[where][group]
    flags = (OPEN * (n > 1) | MANY * (n > most))[group] | FIRST * (d == least)  # rows in several packs can share an id
    told, first = np.empty(len(k), np.uint8), np.empty(len(k), np.int64)
    told[order], first[order] = flags, least
    ends, out = np.cumsum(np.bincount(src, minlength=len(rows))), []
    for (pack, _), a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        out.append((pack, told[a:b].tobytes() + first[a:b][(told[a:b] & FIRST) == 0].tobytes()))
    return out


def answer_windows(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Which windows an earlier document holds, as bits."""
    k, d, src, new, order = gathered(rows, 2)
    if not len(k):
        return []
    earlier = np.empty(len(k), bool)
    earlier[order] = d[np.flatnonzero(new)][np.cumsum(new) - 1] < d
    ends = np.cumsum(np.bincount(src, minlength=len(rows)))
    return [(pack, np.packbits(earlier[a:b]).tobytes()) for (pack, _), a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def answer_text(rows: list[tuple[int, bytes]], window: int) -> list[tuple[int, bytes]]:
    """For each entry, bits for its windows in order of their starts: those that an earlier document holds."""
    parts, texts, counts = [], [], []
    for _, blob in rows:
        n, at, own = int(np.frombuffer(blob, np.uint32, 1)[0]), 4, []
        for kind in (R.U, np.int64, np.uint32, np.uint8, np.uint8):
            own.append(np.frombuffer(blob, kind, n, at))
            at += n * own[-1].itemsize
        parts.append(own), texts.append(np.frombuffer(blob, np.uint8, -1, at)), counts.append(n)
    anchor, holder, size, high, low = map(np.concatenate, zip(*parts, strict=True))
    data, high, low = np.concatenate(texts), high.astype(np.int64), low.astype(np.int64)
    start, end, first = R.words(data, np.r_[0, np.cumsum(size, dtype=np.int64)])
    word = (R.numbered(data, start, end)[2] + 1).astype(np.uint32)  # in this bucket; zeros stand beyond the end
    at = first[:-1] + high
    left, right = SuffixArray(anchor, columns(word, first[:-1], at, backwards=True), 1), SuffixArray(anchor, columns(word, at, first[1:]), 1)
    many = high - low + 1
    begin = np.cumsum(many) - many
    earlier = np.zeros(int(many.sum()), bool)
    for o, some, number in equal_windows(left, right, low, high, first[1:] - at, window):
        least = np.full(number.max() + 1, NO_ID)
        np.minimum.at(least, number, holder[some])
        earlier[begin[some] + high[some] - o] = least[number] < holder[some]
    cut, ends = np.r_[begin, len(earlier)], np.cumsum(counts)
    return [(pack, np.packbits(earlier[cut[a] : cut[b]]).tobytes()) for (pack, _), a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = 5, most: int = HOT) -> DataFrame:
    """Per document: ``doc_id, n_words, spans`` (the removed word ranges) and ``kept`` (the words that remain, joined by a space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = P.text_bytes(docs)
    # A word of some six bytes; a phrase of 32 bytes for each four or five words; some phrases go as text, of hot anchors as windows.
    n1, n2, n3 = P.bucket_count(total * 32 / 27), P.bucket_count(total), P.bucket_count(total)
    packs, secret = P.packed(docs), R.new_key()

    def ask_phrases(pack, table):
        x = Block(table, window, gram, secret)
        for b, s in P.slices(x.anchor, n1).items():
            yield b, x.anchor[s].tobytes() + x.phrase[s].T.tobytes() + x.holder[s].tobytes()

    def ask_open(pack, table, told):
        x = Block(table, window, gram, secret)
        text, many = x.open(x.told(told, n1)[1])
        yield from x.ask_text(text, n2)
        a, c, ids, _, _ = x.windows(many)
        for b, s in P.slices(a, n3).items():
            yield n2 + b, a[s].tobytes() + c[s].tobytes() + ids[s].tobytes()

    def answer_open(bucket, rows):
        return answer_text(rows, window) if bucket < n2 else answer_windows(rows)

    def cut(pack, table, told):
        x = Block(table, window, gram, secret)
        first, flags = x.told(told[0], n1)
        own = x.ids[x.doc]
        whole = np.flatnonzero((own != NO_ID) & (first[x.entry] < own))
        held = np.zeros(int(x.bounds[-1]), bool)  # starts that an earlier document has
        # Of open phrases, for the documents with the least id that holds them (others have them whole).
        text, many = x.open(flags)
        some, bits = np.zeros(len(x.anchor), bool), np.zeros(len(held), bool)
        some[text] = some[many] = True
        for b, s in P.slices(x.anchor[text], n2).items():
            y = x.some[text[s]]
            p = R.ranges(x.first[y], x.last[y] + 1)
            bits[p] = np.unpackbits(np.frombuffer(told[1][b], np.uint8), count=len(p)).astype(bool)
        a, _, ids, place, p = x.windows(many)
        earlier = np.zeros(len(a), bool)
        for b, s in P.slices(a, n3).items():
            earlier[s] = np.unpackbits(np.frombuffer(told[1][n2 + b], np.uint8), count=s.stop - s.start).astype(bool)
        # The first of equal windows here can have a larger id than another pack's, or a smaller one than its equals here.
        bits[p] = earlier[place] | (ids[place] < np.repeat(x.holder[many], (x.last - x.first)[x.some[many]] + 1))
        same = np.flatnonzero(some[x.entry] & (first[x.entry] == own))
        of = x.some[x.entry[same]]  # the occurrence that was asked for; one phrase may stand several times
        n = (x.last - x.first)[same] + 1
        held[R.ranges(x.first[same], x.last[same] + 1)] = bits[R.ranges(x.first[of], x.first[of] + n)]
        held[R.ranges(x.first[whole], x.last[whole] + 1)] = True
        gone = R.covered(np.flatnonzero(held), window, len(held))
        text, spans, ends, kept = x.data.tobytes(), [], [0], []
        for i, (a, b) in enumerate(zip(x.bounds[:-1], x.bounds[1:], strict=True)):
            words, g = text[x.offsets[i] : x.offsets[i + 1]].split(), gone[a:b]
            if g.any():
                edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                spans.append(edge)
                ends.append(ends[-1] + len(edge) // 2)
                words = [w for w, lost in zip(words, g.tolist(), strict=True) if not lost]
            else:
                ends.append(ends[-1])
            kept.append(b" ".join(words))
        edge = np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(edge[0::2]), pa.array(edge[1::2])], ["start", "end"])
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(x.bounds)), "spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), "kept": pa.array(kept, pa.binary())})

    phrases = P.answer(P.ask(packs, ask_phrases), lambda bucket, rows: answer_phrases(rows, most))
    opened = P.answer(P.ask_again(packs, phrases, ask_open), answer_open)
    return P.apply(packs, [phrases, opened], cut, SCHEMA, OUT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, hash(list(w) OVER x) AS h, md5(array_to_string(list(w) OVER x, ' ')) AS m, count(*) OVER x AS n FROM w
  WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), f AS (SELECT h, m, min(doc_id) AS d FROM g WHERE n = 13 GROUP BY h, m),
s AS (SELECT g.doc_id, g.i FROM g JOIN f USING (h, m) WHERE g.n = 13 AND f.d < g.doc_id),
t AS (SELECT w.doc_id, w.i, w.w, s.i AS s FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.i = w.i),
u AS (SELECT doc_id, i, w, max(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t)
SELECT d.doc_id, count(u.i) AS n_words, count(*) FILTER (u.gone) AS n_removed, sha256(coalesce(string_agg(u.w, ' ' ORDER BY u.i) FILTER (NOT u.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id
"""
