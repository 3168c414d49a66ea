"""Near-duplicate documents: a set similarity join on word shingles with vertical partitioning.

Method.
1. Global order. Each pack sends its distinct shingles once; buckets count in how many documents each stands. The order is by this
   frequency, in steps of a factor of two (ties: by hash), so what many documents share comes last. A shingle travels as a number of 64 bits, its step
   in the upper six and its hash below, so these numbers stand in the global order. Shingles of one document can't add to any overlap.
2. Classes. Documents with equal sets fold into a class with one representative, before anything is joined. A document with fewer than
   80 % of its shingles in other documents can't have a partner and drops out, nor can one of three shingles and fewer; classes of these go by the
   shingles themselves.
3. Candidates. Partners share a shingle among the first ``n - ceil(0.8 n) + 1`` in global order. Instead of pairs, each such
   shingle gives a link to its least holder; connected classes make a *unit*, so rows grow with the shingles, not with pairs.
4. Vertical partitioning. The global order is cut into ``FRAGMENTS`` of equal weight (by a histogram over all sets), and so is every set. A task has the
   segments of one fragment: it counts the partial overlap of each pair within a unit, as a product of incidence blocks, and drops what the lengths and
   the rest of the order can't bring to the threshold any more. Partial counts travel as compressed blocks of numbers and are summed for each pair,
   then tested. Small units share tasks. A unit over ``BLOCK`` classes is cut into blocks, and every pair of blocks is a task of its own, so no
   task holds more than two blocks, whatever the unit's size; every pair within the unit is still tested, once.
5. The sums give a spanning forest of the links and each class's number of links, never the pairs.

Rows: every input row gives one row. Null and wordless texts have no shingles and are linked with nothing; with under five words the whole
sequence is the one shingle; null ids are allowed (they take the least id of their component, or stay null); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packs as P
from . import _prints as R
from ._session import checkpoints
from .graph import components

NO_ID = np.iinfo(np.int64).max
#: Into how many tasks the order cuts a unit, or a pair of its blocks.
FRAGMENTS = 4
FRAGMENT = 2048  # columns of an incidence block
BLOCK = 1024
#: Labels and sizes of large units (24 bytes each) that may be sent to every task.
SENT = 50_000
#: Classes that one task of small units gets, about.
SHARE = 256
#: How many shingles a pack sends to a bucket, and how many of them stand in several of its documents.
HEAD = "<ii"
OUT = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("shared", pa.binary()), ("n_prefix", pa.int32())])
SCHEMA = "doc_id long, n_shingles long, class binary, shared binary, n_prefix int"


def shingle_sets(table: pa.Table, size: int, key: int) -> list[np.ndarray]:
    """Each document's distinct shingles, as sorted joins of keyed word hashes."""
    data, offsets = P.texts(table)
    out = []
    for a, b in P.chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        part = R.LOW[data[offsets[a] : offsets[b]]]
        start, end, first = R.words(part, at)
        word = R.prints_of(part, start, end, key)
        grams = R.grams(word, size)
        short = np.flatnonzero((first[1:] > first[:-1]) & (first[1:] - first[:-1] < size))
        whole = dict(zip(short.tolist(), R.stretches(word, 1, first[short], first[short + 1])[:, None], strict=True))
        for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            out.append(R.distinct(grams[i : j - size + 1]) if j - i >= size else whole.get(k, np.zeros(0, R.U)))
    return out


def few(text: str, size: int) -> bytes:
    """The distinct shingles of a text as they are, for sets so small that a chance fingerprint would count."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six separators
    every = {b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))}
    return b"\n".join(sorted(every))


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def classified(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Steps 1 and 2: per document its class and, once a pack and class, the shared shingles in global order."""
    carried = docs.columns[2:]
    out = pa.schema([*OUT, *[(c, pa.int64()) for c in carried]])
    total = P.text_bytes(docs)
    n = P.bucket_count(2 * total)  # five bytes for each word of some six; smaller buckets fill partitions more evenly
    packs, secret = P.packed(docs), R.new_key()

    def short(prints):
        """Bucket and 40 further bits: enough to count by. Two shingles that share them count as one here, everywhere alike, which can
        move them in the order but not change an overlap, as sets are compared by whole fingerprints."""
        return P.to_buckets(prints, n).astype(R.U) << R.U(40) | prints & R.U((1 << 40) - 1)

    def own(table):
        sets = shingle_sets(table, size, secret)
        return sets, short(np.concatenate(sets)) if sets else np.zeros(0, R.U)

    # A pack has a row for nearly each bucket, so on large inputs these are many and short: what is done for a row is a few slices of whole arrays.
    def ask(pack, table):
        key, count = np.unique(own(table)[1], return_counts=True)
        more = np.flatnonzero(count > 1)
        often, five = count[more].astype(np.int32), key.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        stands = P.stretches((key >> R.U(40)).astype(np.int64))
        ends = np.searchsorted(more, [x for s in stands.values() for x in (s.start, s.stop)]).tolist()
        for (b, s), i, j in zip(stands.items(), ends[::2], ends[1::2], strict=True):
            yield b, struct.pack(HEAD, s.stop - s.start, j - i) + (more[i:j] - s.start).astype(np.int32).tobytes() + often[i:j].tobytes() + five[5 * s.start : 5 * s.stop]

    def answer(bucket, rows):
        press = zstandard.ZstdCompressor(1).compress
        heads = [struct.unpack_from(HEAD, blob) for _, blob in rows]
        ends = np.cumsum([0, *(m for m, _ in heads)])
        key, count = np.zeros((ends[-1], 8), np.uint8), np.ones(ends[-1], np.int64)
        key[:, :5] = np.frombuffer(b"".join(blob[8 + 8 * more :] for (_, blob), (_, more) in zip(rows, heads, strict=True)), np.uint8).reshape(-1, 5)
        key = key.view(R.U).ravel()
        for (_, blob), (_, more), a in zip(rows, heads, ends[:-1].tolist(), strict=True):
            if more:
                count[a + np.frombuffer(blob, np.int32, more, 8)] = np.frombuffer(blob, np.int32, more, 8 + 4 * more)
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(count, first) if len(first) else first, np.diff(first, append=len(key)))
        at = np.flatnonzero(total > 1)
        # As steps and low counts, which compress to a quarter.
        count, step, begin = np.minimum(total[at], 2**31 - 1).astype(np.int32), np.diff(at, prepend=0), np.searchsorted(at, ends)
        some = begin[:-1] < begin[1:]
        step[begin[:-1][some]] = at[begin[:-1][some]] - ends[:-1][some]
        step = step.astype(np.int32)
        for (pack, _), i, j in zip(rows, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield pack, press(step[i:j].tobytes() + count[i:j].tobytes())

    def classify(pack, table, told):
        sets, flat = own(table)
        key, index = np.unique(flat, return_inverse=True)
        stands = P.stretches((key >> R.U(40)).astype(np.int64))
        frequency, unpress = np.ones(len(key), np.int64), zstandard.ZstdDecompressor().decompress
        for b, x in told[0].items():
            step, f = np.frombuffer(unpress(x), np.int32).reshape(2, -1)
            frequency[stands[b].start + np.cumsum(step)] = f
        frequency, end = frequency[index], 0
        names, shared, n_prefix, seen = [], [], [], set()
        for s, text in zip(sets, table.column("text"), strict=True):
            start, end = end, end + len(s)
            alone = len(s) * (100 - percent) < percent  # no other set can reach the similarity
            name = hashlib.blake2b(few(text.as_py(), size) if alone else s.tobytes(), digest_size=16).digest() if len(s) else None
            names.append(name)
            shared.append(None), n_prefix.append(None)
            if name is None or name in seen:
                continue
            seen.add(name)
            f = frequency[start:end]
            often = f > 1
            if (k := int(often.sum())) >= least_overlap(len(s), percent):
                step = np.log2(f[often]).astype(R.U)
                shared[-1] = b"" if alone else np.sort(step << R.U(58) | s[often] >> R.U(6)).tobytes()
                n_prefix[-1] = 0 if alone else len(s) - least_overlap(len(s), percent) + 1 - (len(s) - k)
        return pa.table({"doc_id": table.column("doc_id"), "n_shingles": [len(s) for s in sets], "class": names, "shared": shared, "n_prefix": n_prefix} | {c: table.column(c) for c in carried}, schema=out)

    return P.apply(packs, [P.answer(P.ask(packs, ask), answer)], classify, SCHEMA + "".join(f", {c} long" for c in carried), out)


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Common shingles of each pair: products of incidence blocks of ``FRAGMENT`` columns, for what stands in two or more sets."""
    sets = x + (y or [])
    flat = np.concatenate(sets)
    key, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = count[index] > 1
    rank = np.cumsum(count > 1) - 1
    col, row = rank[index[kept]], row[kept]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    total = np.zeros((len(x), len(y) if y is not None else len(x)), np.float32)
    width = int(rank[-1]) + 1 if len(rank) else 0
    for a in range(0, width, FRAGMENT):
        i, j = np.searchsorted(col, [a, a + FRAGMENT])
        part = np.zeros((len(sets), min(FRAGMENT, width - a)), np.float32)
        part[row[i:j], col[i:j] - a] = 1
        total += part[: len(x)] @ (part[len(x) :] if y is not None else part).T
    return total


def pivots(sets: DataFrame, fragments: int) -> np.ndarray:
    """Where the order is cut so that fragments weigh about the same: from a histogram of 4,096 ranges over all sets."""

    def weigh(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), R.U) >> R.U(52)
            held = np.bincount(flat.astype(np.int64), minlength=4096)
            yield pa.record_batch({"bin": pa.array(np.flatnonzero(held)), "n": pa.array(held[held > 0])})

    rows = sets.mapInArrow(weigh, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    sums = np.cumsum([r.n for r in rows])
    at = np.searchsorted(sums, [sums[-1] * k / fragments for k in range(1, fragments)]) if rows else []
    return np.unique(np.array([(rows[i].bin + 1) << 52 for i in at if rows[i].bin < 4095], R.U))


class Side(list):
    """Classes of one block: names, sizes of the whole sets, and their segments of a fragment."""

    def __init__(self, rows: list[tuple[bytes, int, bytes]]):
        super().__init__(np.frombuffer(s, R.U) for _, _, s in rows)
        self.names, self.sizes = [c for c, _, _ in rows], np.array([n for _, n, _ in rows], np.int64)


def partial(x: Side, y: Side | None, percent: int) -> bytes | None:
    """The counts of one fragment, where they can still matter, as a compressed block; None if there are none."""
    z = x if y is None else y
    common = overlaps(x, y).astype(np.int64)
    own, other = np.array([len(s) for s in x])[:, None], np.array([len(s) for s in z])[None, :]
    n, m = x.sizes[:, None], z.sizes[None, :]
    most = common + np.minimum(n - own, m - other)  # if all that is left were shared
    common[100 * most < percent * (n + m - most)] = 0
    if y is None:
        common = np.triu(common, 1)
    if not common.any():
        return None
    head = np.array([len(x), -1 if y is None else len(y)], np.int64)
    sides = [x] if y is None else [x, y]
    parts = [head.tobytes(), *[b"".join(s.names) + s.sizes.tobytes() for s in sides], common.astype(np.uint32).tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def summed(blobs: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray], np.ndarray]:
    """The names and sizes of each side (one, if a block meets itself), and the sums of the partial counts of a pair of blocks."""
    parts, names, sizes = [], [{}, {}], [[], []]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        k, m = np.frombuffer(raw, np.int64, 2).tolist()
        at, place = 16, []
        for side, count in enumerate([k] if m < 0 else [k, m]):
            own, n = [raw[at + 16 * i : at + 16 * i + 16] for i in range(count)], np.frombuffer(raw, np.int64, count, at + 16 * count).tolist()
            at += 24 * count
            for c, size in zip(own, n, strict=True):
                if c not in names[side]:
                    names[side][c] = len(names[side])
                    sizes[side].append(size)
            place.append([names[side][c] for c in own])
        parts.append((place[0], place[-1], np.frombuffer(raw, np.uint32, -1, at).reshape(k, k if m < 0 else m)))
    sides = 2 if names[1] else 1
    total = np.zeros((len(names[0]), len(names[sides - 1])), np.int64)
    for i, j, count in parts:
        total[np.ix_(i, j)] += count
    if sides == 1:
        total += total.T
    return [list(x) for x in names[:sides]], [np.array(x, np.int64) for x in sizes[:sides]], total


def linked(sides: list[list[bytes]], sizes: list[np.ndarray], common: np.ndarray, percent: int):
    """Rows ``(class, another or itself, links)`` for the classes of a pair of blocks (or of one) that have links."""
    n, m, alone = sizes[0], sizes[-1], len(sides) == 1
    link = (common > 0) & (100 * common >= percent * (n[:, None] + m[None, :] - common))
    names = [c for side in sides for c in side]
    degree = link.sum(1) if alone else np.concatenate([link.sum(1), link.sum(0)])
    # A forest: breadth first over rows of the link matrix.
    k, root = len(sides[0]), np.full(len(names), -1)
    for start in np.flatnonzero(degree[:k]):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        while queue:
            v = queue.pop()
            if alone:
                near = np.flatnonzero(link[v])
            else:
                near = np.flatnonzero(link[v]) + k if v < k else np.flatnonzero(link[:, v - k])
            near = near[root[near] < 0]
            root[near] = start
            queue += near.tolist()
    for v in np.flatnonzero(degree):
        yield names[v], names[root[v]], int(degree[v])


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, carry: tuple[str, ...] = (), fragments: int = FRAGMENTS) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (least id reachable), ``n_links`` (other shingle sets it is linked with) and the long columns ``carry``."""
    checkpoints(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows = classified(docs, size, percent).checkpoint()
    # No join of this operator but that with ``sized`` may be a broadcast: their sides grow with the input, and small ones would pass through the driver up to Spark's threshold.
    classes = (
        rows.where("class IS NOT NULL").groupBy("class")
        .agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("shared", True).alias("shared"), F.first("n_prefix", True).alias("n_prefix"))
        .where("shared IS NOT NULL").checkpoint()
    )

    def prefixes(batches):
        for batch in batches:
            token, name = [np.zeros(0, np.int64)], []
            for c, s, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                token.append(np.frombuffer(s, np.int64)[:k])
                name += [c] * k
            yield pa.record_batch({"token": pa.array(np.concatenate(token)), "class": pa.array(name, pa.binary())})

    token = classes.select("class", "shared", "n_prefix").mapInArrow(prefixes, "token long, class binary").checkpoint()
    holder = token.groupBy("token").agg(F.min("class").alias("b"), F.count("*").alias("k")).where("k > 1").select(F.col("token").alias("t"), "b")
    unit = components(token.join(holder.hint("merge"), F.col("token") == F.col("t")).select(F.col("class").alias("a"), "b"))
    # Only units over BLOCK classes need their size; as a rule there are few, and then no shuffle gathers a unit.
    sized = unit.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).checkpoint()
    sized = F.broadcast(sized) if sized.count() <= SENT else sized
    members = (
        unit.join(sized, "label", "left").select(F.col("node").alias("class"), "label", F.coalesce("size", F.lit(1)).alias("size"))
        .join(classes.select("class", "n", "shared").hint("merge"), "class").checkpoint()
    )
    tasks = max(1, -(-members.count() // SHARE))
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), F.greatest(chunks, F.lit(1))).cast("int")
    small = members.where(F.col("size") <= BLOCK).select(
        F.pmod(F.xxhash64("label"), F.lit(tasks)).cast("string").alias("task"), "label", F.lit(0).alias("side"), F.lit(False).alias("cross"), "class", "n", "shared",
    )
    large = members.where(F.col("size") > BLOCK).select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    large = large.select(
        F.concat_ws("/", F.hex("label"), F.least("own", "other"), F.greatest("own", "other")).alias("task"), "label",
        (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("cross"), "class", "n", "shared",
    )

    cuts = pivots(members.select("shared"), fragments)

    def cut(batches):
        for batch in batches:
            rest = batch.drop_columns(["shared"])
            row, fragment, segment = [], [], []
            for i, blob in enumerate(batch.column("shared").to_pylist()):
                ends = [*(8 * np.searchsorted(np.frombuffer(blob, R.U), cuts)).tolist(), len(blob)]
                for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if b > a:
                        row.append(i), fragment.append(k), segment.append(blob[a:b])
            taken = rest.take(pa.array(row, pa.int32()))
            yield pa.record_batch({**{c: taken.column(c) for c in rest.schema.names}, "fragment": pa.array(fragment, pa.int32()), "segment": pa.array(segment, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        units: dict[bytes, tuple[bool, list, list]] = {}
        for label, side, cross, c, n, s in zip(*(table.column(x).to_pylist() for x in ("label", "side", "cross", "class", "n", "segment")), strict=True):
            units.setdefault(label, (cross, [], []))[1 + side].append((c, n, s))
        out = []
        for label, (cross, x, y) in units.items():
            if x and (y or not cross) and (blob := partial(Side(x), Side(y) if cross else None, percent)):
                out.append((label, blob))
        P.trim()
        task = table.column("task")[0].as_py() if table.num_rows else ""
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"task": pa.array([task] * len(out), pa.string()), "label": pa.array(a, pa.binary()), "blob": pa.array(b, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        units: dict[bytes, list[bytes]] = {}
        for label, blob in zip(table.column("label").to_pylist(), table.column("blob").to_pylist(), strict=True):
            units.setdefault(label, []).append(blob)
        out = [x for blobs in units.values() for x in linked(*summed(blobs), percent)]
        P.trim()
        a, b, k = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(k, pa.int64())})

    kinds = "task string, label binary, side int, cross boolean, class binary, n long, fragment int, segment binary"
    segments = small.unionAll(large).mapInArrow(cut, kinds)
    partials = segments.groupBy("task", "fragment").applyInArrow(count, "task string, label binary, blob binary")
    links = partials.groupBy("task").applyInArrow(add, "a binary, b binary, links long").checkpoint()
    joined = components(links.select("a", "b"))
    least = joined.join(classes.select(F.col("class").alias("node"), "least").hint("merge"), "node").groupBy("label").agg(F.min("least").alias("component_id"))
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    found = joined.join(least.hint("merge"), "label").join(degree.hint("merge"), "node").select(F.col("node").alias("class"), "component_id", "n_links")
    # Cut here, the last join has nothing above or below it, so Spark may split the rows of a class that a third of all documents share.
    alone = classes.select("class", "least").join(found.hint("merge"), "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id"), "n_links").checkpoint()
    return rows.select("doc_id", "n_shingles", "class", *carry).join(alone.hint("merge"), "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *carry,
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, both_ways.y FROM r JOIN both_ways ON r.b = both_ways.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
