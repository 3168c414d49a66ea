"""Segmentation of files that are larger than a row.

:mod:`.segment` keeps a file's lines in one array. Here lines stay rows, and nothing is ever collected by file: headers are counted by partial
aggregates, lines are cut into blocks of ``BLOCK`` consecutive numbers, and what a block has to know of the ones before it (how many headers, which
segment is open at its first line) comes from a prefix scan over the blocks. Every shuffle of lines or segments is keyed by file and block,
or by file and number, so a file of any length is spread out; only one small row a block meets the others of its file. The segments are those of
:func:`.segment.segments` for the same lines, however these are partitioned.

Lines are ``source_file`` (not null), ``line_no`` (from 0 without gaps) and ``text``; other columns travel along. They are read several times, so
they should be a table, not a scan that has to be decoded again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_strip
from .segment import LEAST_COPIES, LEAST_LENGTH, LOOK_BACK, REQUIRED

BLOCK = 1 << 16


def block_of(order: str, block: int) -> Column:
    return F.expr(f"{order} div {block}")


def running_sum(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows with the same keys up to and with this one, by the whole number ``order``.

    A prefix scan in two levels: each block of ``order`` is added up by itself, the sums of the blocks run over one row a block, and rows run only
    within their block. Keys and ``order`` are not null.
    """
    dealt = rows.withColumn("_block", block_of(order, block))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")).select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before, [*keys, "_block"]).withColumn(name, F.sum(value).over(within) + F.col("_before")).drop("_block", "_before")


def can_be_header(line: Column, required: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (line.contains(w) for w in required), F.length(line) >= LEAST_LENGTH)


def headers(lines: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES) -> DataFrame:
    """``source_file, n_lines, anchor_text, n_anchors``: the most frequent line that can be a header, the first of equals; both null without one."""
    sizes = lines.groupBy("source_file").agg((F.max("line_no") + 1).alias("n_lines"))
    stripped = lines.select("source_file", "line_no", ws_strip("text").alias("line")).where(can_be_header(F.col("line"), required))
    counted = stripped.groupBy("source_file", "line").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).where(F.col("n") >= copies)
    best = counted.groupBy("source_file").agg(F.max(F.struct("n", (-F.col("first")).alias("before"), "line")).alias("best"))
    return sizes.join(best, "source_file", "left").select("source_file", "n_lines", F.col("best.line").alias("anchor_text"), F.col("best.n").alias("n_anchors"))


def anchors(lines: DataFrame, heads: DataFrame, required: Sequence[str] = REQUIRED, block: int = BLOCK) -> DataFrame:
    """``source_file, line_no, anchor_text, anchor_no`` (from 0). The header is handed to each block of its file, so lines meet it in their block."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), block_of("(n_lines - 1)", block)))
    handed = heads.where("anchor_text IS NOT NULL").select("source_file", "anchor_text", every.alias("_block"))
    stripped = lines.select("source_file", "line_no", ws_strip("text").alias("_line"), block_of("line_no", block).alias("_block")).where(can_be_header(F.col("_line"), required))
    found = stripped.join(handed, ["source_file", "_block"]).where(F.col("_line") == F.col("anchor_text")).select("source_file", "line_no", "anchor_text", F.lit(1).alias("_one"))
    return running_sum(found, ["source_file"], "line_no", "_one", "anchor_no", block).select("source_file", "line_no", "anchor_text", (F.col("anchor_no") - 1).cast("int").alias("anchor_no"))


def segments(lines: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES, block: int = BLOCK) -> DataFrame:
    """``source_file, segment_index, start_line, end_line, anchor_text, gated`` as :func:`.segment.segments` has them.

    A segment ends before its successor, found by its number; the last one's successor is the end of the file.
    """
    heads = headers(lines, required, copies)
    at = anchors(lines, heads, required, block)
    starts = at.select("source_file", F.col("anchor_no").alias("segment_index"), F.greatest(F.col("line_no") - LOOK_BACK, F.col("anchor_no")).alias("start_line"), "anchor_text")
    whole = heads.where("anchor_text IS NULL").select("source_file", F.lit(0).alias("segment_index"), F.lit(0).alias("start_line"), "anchor_text")
    starts = starts.unionByName(whole)
    successor = starts.where("segment_index > 0").select("source_file", (F.col("segment_index") - 1).alias("segment_index"), F.col("start_line").alias("next"))
    ends = heads.select("source_file", (F.coalesce("n_anchors", F.lit(1)) - 1).cast("int").alias("segment_index"), F.col("n_lines").alias("next"))
    both = starts.join(successor.unionByName(ends), ["source_file", "segment_index"])
    return both.select("source_file", "segment_index", "start_line", (F.col("next") - 1).alias("end_line"), "anchor_text", F.col("anchor_text").isNull().alias("gated"))


def assigned(lines: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every line that belongs to a segment, with ``segment_index``: a running count of starts, carried over the borders of blocks."""
    starts = bounds.select("source_file", F.col("start_line").alias("line_no"), F.lit(1).alias("_starts"))
    marked = lines.join(starts, ["source_file", "line_no"], "left").withColumn("_starts", F.coalesce("_starts", F.lit(0)))
    counted = running_sum(marked, ["source_file"], "line_no", "_starts", "segment_index", block)
    return counted.withColumn("segment_index", (F.col("segment_index") - 1).cast("int")).where("segment_index >= 0").drop("_starts")
