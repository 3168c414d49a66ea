"""URL filter lists: a blocked Bloom filter passes possible hits to an exact hash join.

Method. A rule is a canonical URL, host and path prefix. A page's possible rules are its host's suffixes (whole labels) with the
prefixes of its path whose lengths occur in the list. A blocked Bloom filter of the list (256-bit blocks, one per hash; eight bits
inside it) is tested first, so almost all of them end there; those that pass are joined with the list itself, which
removes false positives. The filter's size follows the list up to ``MOST_BLOCKS`` (1 MB), so what is sent to every task is
bounded; beyond that more false positives reach the join, and results stay exact. Pages without a possible hit pass by without a shuffle. The longest
rule that fits decides (its text's length; ties: the larger text); a page without one gets the default verdict.

Rows: every input row gives one row; null url or one without ``://`` has empty host and path; repeated ids are kept apart; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BLOCKS = 1 << 15
BITS_PER_RULE = 16
#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def places(key: Column, blocks: int) -> Column:
    """The eight bit positions of a key, all in one block of 256: its number from one hash, and a byte of another for each."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda s: block * 256 + F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit("in")), s).bitwiseAND(F.lit(255)))


def bloom(rules: DataFrame) -> tuple[Column, int]:
    """The filter as an array of longs, and its number of blocks."""
    n, blocks = rules.count(), 1
    while blocks * 256 < n * BITS_PER_RULE and blocks < MOST_BLOCKS:
        blocks *= 2
    at = rules.select(F.explode(places(F.col("rule"), blocks)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).collect()
    held = {r.i: r.b for r in words}
    return F.from_json(F.lit(str([held.get(i, 0) for i in range(blocks * 4)])), "array<bigint>"), blocks


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``. ``rules`` has ``verdict, host, path``."""
    rules = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("n")).dropDuplicates(["rule"])
    # Lengths of rule paths: bounded by the longest URL, not by the number of rules.
    lengths = F.array(*[F.lit(r.n) for r in rules.select("n").distinct().orderBy("n").collect()]).cast("array<int>")
    filter_, blocks = bloom(rules)
    host, path = parts(F.col("url").cast("string"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    hit = lambda k: F.forall(places(k, blocks), lambda p: F.call_function("getbit", F.get(filter_, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    tested = pages.select("*", F.filter(keys, hit).alias("keys"))
    passed = tested.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    possible = tested.where(F.size("keys") > 0).select("row", "page_id", "host", "path", F.explode("keys").alias("key"))
    exact = possible.join(rules.select("rule", "verdict"), F.col("key") == F.col("rule"), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))))
    done = exact.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return passed.unionByName(done.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + " AS t(verdict, host, path)")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, host, path, h || q AS rule, verdict FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""
