"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Method. Shingles of three words (fewer where an item has fewer) are ordered by rarity, counted over all documents. A document that
holds a window of an item holds all its shingles, so the rarest one alone is a sufficient prefix: windows are joined on it. The
join carries the window's length and the shingle's place in it (the length and positional bounds): the window must fit in the
document around the shingle. What passes is verified word by word over the item-sized window.

Before the join a bit set marks the hashes of the wanted shingles, 128 bits or more for each, up to ``2**MOST_BITS``; document positions outside
it are hardly ever exploded. Texts are read twice, to count and to match: what is counted would be too much to keep where common shingles are wanted. Both sides of the joins are left to Spark, which broadcasts the benchmark's side only if it measures
below the session's threshold.

Rows: every input row gives one row, also null, empty or repeated ones; null texts and ids of items are allowed (an item without an id counts
for hits but is not named); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import checkpoints

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but words, before folding.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: One megabyte of bits, for some 65,000 shingles; with more of them more positions reach the join.
MOST_BITS = 23
SHINGLE = 3


def words(text: Column) -> Column:
    """Words as they stand in the text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def fold(words: Column) -> Column:
    """A-Z only; exact, but slow on whole texts."""
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def shingle(words: Column, i: Column, q: int) -> Column:
    """The hash of the q words from position i (from 0), by full lower case: words equal after :func:`fold` are equal here."""
    return F.xxhash64(*[F.lower(F.get(words, i + j)) for j in range(q)])


def item_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """``item_id, window`` (an array of words): all windows of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), fold(words(F.col("text").cast("string"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window")).distinct()


def bit_set(hashes: DataFrame) -> tuple[Column, int]:
    """Bits of ``h`` as an array of longs, and the logarithm of how many; at most a megabyte comes to the driver, whatever the table's size."""
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(128 * max(hashes.count(), 1)))))
    bit = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.select(F.shiftright(bit, 6).alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect()
    held = {r.i: r.b for r in rows}
    return F.from_json(F.lit(str([held.get(i, 0) for i in range(1 << bits - 6)])), "array<bigint>"), bits


def marked(bits: tuple[Column, int], h: Column) -> Column:
    at = F.shiftright(h.bitwiseAND(F.lit((1 << bits[1]) - 1)), 6).cast("int")
    return F.call_function("getbit", F.get(bits[0], at), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def positions(docs: DataFrame, bits: dict[int, tuple[Column, int]], payload) -> DataFrame:
    """The columns of ``docs`` without ``w``, and a row for each marked shingle (null if none): ``q, h, i`` and ``payload(w, i)``.

    Hashes stand in an array of numbers first; only marked ones become structs.
    """

    def hashes(q: int) -> Column:
        starts = F.slice("low", 1, F.greatest(F.size("low") - q + 1, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(F.col("low"), i + j) for j in range(1, q)]))

    def found_of(q: int) -> Column:
        at = F.filter(F.transform(f"h{q}", lambda h, i: F.when(marked(bits[q], h), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(F.lit(q).alias("q"), F.get(f"h{q}", i).alias("h"), i.alias("i"), *payload(F.col("w"), i)))

    rest = [c for c in docs.columns if c != "w"]
    hashed = docs.select("*", F.transform("w", lambda x: F.lower(x)).alias("low")).select(*rest, "w", *[hashes(q).alias(f"h{q}") for q in sorted(bits)])
    found = [found_of(q) for q in sorted(bits)]
    return hashed.select(*rest, F.explode_outer(found[0] if len(found) == 1 else F.concat(*found)).alias("x")).select(*rest, "x.*")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, key: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit`` and ``items`` (the ids, as strings, of items with a window in it, sorted). ``key`` is the
    column that names documents in the result, as ``doc_id``."""
    checkpoints(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id") if key == "doc_id" else F.col(key).alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    windows = item_windows(benchmark, length)
    # Every shingle of every window, with its place in it.
    shingles = windows.select(
        "item_id", "window", F.least(F.size("window"), F.lit(SHINGLE)).alias("q"),
    )
    sizes = sorted(r.q for r in shingles.select("q").distinct().collect())  # at most SHINGLE values
    if not sizes:
        return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))

    def shingles_of(q: int) -> Column:
        return F.when(F.col("q") == q, F.transform(F.sequence(F.lit(0), F.size("window") - q), lambda i: F.struct(shingle(F.col("window"), i, q).alias("h"), i.alias("at"))))

    each = F.coalesce(*[shingles_of(q) for q in sizes])
    shingles = shingles.select("item_id", "window", "q", F.explode(each).alias("s")).select("item_id", "window", "q", "s.h", "s.at")

    # Rarity: occurrences in all documents.
    vocabulary = shingles.select("q", "h").distinct()
    bits = {q: bit_set(vocabulary.where(F.col("q") == q)) for q in sizes}
    seen = positions(docs.select("w"), bits, lambda w, i: []).where(F.col("h").isNotNull()).groupBy("q", "h").count()
    rarity = vocabulary.join(seen, ["q", "h"], "left").select("q", "h", F.coalesce("count", F.lit(0)).alias("n"))
    # The prefix: the rarest shingle of each window (ties: smaller hash, then place).
    prefix = (
        shingles.join(rarity, ["q", "h"]).groupBy("item_id", "window", "q").agg(F.min(F.struct("n", "h", "at")).alias("s"))
        .where("s.n > 0").select("item_id", "window", "q", "s.h", "s.at")
    )
    prefix = prefix.checkpoint()
    bits = {q: bit_set(prefix.where(F.col("q") == q).select("h")) for q in sizes}

    # Candidates: marked positions, with the words around them that a window can reach.
    reach = length - 1
    around = lambda w, i: [F.greatest(i - reach, F.lit(0)).alias("from"), F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + SHINGLE).alias("near")]
    told = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("w").cast("long").alias("n_words"), "w")
    found = positions(told, bits, around)
    start = F.col("i") - F.col("at")
    joined = found.join(prefix.select("item_id", "window", F.col("q").alias("pq"), F.col("h").alias("ph"), "at"), (F.col("q") == F.col("pq")) & (F.col("h") == F.col("ph")), "left")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = F.when(fits, fold(F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), F.size("window"))) == F.col("window"))
    hit = F.when(same, F.struct(start.alias("a"), (start + F.size("window")).alias("b")))
    done = joined.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.collect_set(F.when(same, F.col("item_id")))).alias("items"))
    # The length of a union of intervals in order of their starts.
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))
    union = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])
    return done.select("doc_id", "n_words", union.cast("long").alias("n_hit"), "items")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    done = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT item_id, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s FROM bw WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
x AS (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM dw, ns WHERE len(ws) >= n)),
m AS (SELECT x.doc_id, x.s, x.n, iw.item_id FROM x JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN i ON i.doc_id = dw.doc_id
"""
