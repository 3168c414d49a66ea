"""Splitting a file of many letters where its header line comes back.

The boundary is a line that a file repeats (at least three times, longer than four signs) and that carries the reference labels. A file's lines
are one array in one row (:func:`files_of` collects them, one shuffle on ``source_file``; scans that have arrays need none); counting
lines, choosing the header and cutting all happen inside the row. Lines are numbered from 0 without gaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_strip
from .metadata import SERVICE_TO, SUBJECT_WORD

# Words that a header line must hold.
REQUIRED = ("पत्रांक", "दिनांक")
LEAST_COPIES = 3
LEAST_LENGTH = 5
LOOK_BACK = 2


def files_of(lines: DataFrame) -> DataFrame:
    """``source_file, lines``: all lines of a file, in order, as structs of the other columns."""
    rest = [c for c in lines.columns if c != "source_file"]
    return lines.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("line_no", *[c for c in rest if c != "line_no"]))).alias("lines"))


def line_frequency(lines: DataFrame) -> DataFrame:
    """``source_file, line, n, first_line_no`` of stripped lines longer than four signs."""
    stripped = lines.select("source_file", "line_no", ws_strip("text").alias("line")).where(F.length("line") >= LEAST_LENGTH)
    return stripped.groupBy("source_file", "line").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line_no"))


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once for each row, also where ``f`` uses it inside a function of elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chosen(stripped: Column, required: Sequence[str], copies: int) -> Column:
    """Of an array of stripped lines the most frequent that can be a header, the first of equals; null without one.

    Sorted by line and place, equal lines stand together, so one pass counts them and keeps the best.
    """
    numbered = F.transform(stripped, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    fits = lambda x: reduce(lambda a, b: a & b, (x["line"].contains(w) for w in required), F.length(x["line"]) >= LEAST_LENGTH)
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("before"), F.lit(None).cast("string").alias("line"))
    start = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("n"), F.lit(0).alias("i"), none.alias("best"))

    def step(s: Column, x: Column) -> Column:
        same = s["line"].eqNullSafe(x["line"])
        n, first = F.when(same, s["n"] + 1).otherwise(1), F.when(same, s["i"]).otherwise(x["i"])
        now = F.struct(n.alias("n"), (-first).alias("before"), x["line"].alias("line"))
        return F.struct(x["line"].alias("line"), n.alias("n"), first.alias("i"), F.when(n >= copies, F.greatest(s["best"], now)).otherwise(s["best"]).alias("best"))

    return F.aggregate(F.array_sort(F.filter(numbered, fits)), start, step, lambda s: s["best"]["line"])


def marked(files: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES) -> DataFrame:
    """``files`` with ``anchor_text`` and ``anchor_lines``, the numbers of the lines that are it."""

    def places(stripped: Column, text: Column) -> Column:
        at = F.filter(F.transform(stripped, lambda x, i: F.when(x == text, i)), lambda i: i.isNotNull())
        return F.struct(text.alias("anchor_text"), at.alias("anchor_lines"))

    stripped = F.transform("lines", lambda x: ws_strip(x["text"]))
    found = bound(stripped, lambda s: bound(chosen(s, required, copies), lambda text: places(s, text)))
    return files.select("*", found.alias("_found")).select("*", "_found.anchor_text", "_found.anchor_lines").drop("_found")


def cut(files: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES) -> DataFrame:
    """``source_file, segment_index, start_line, end_line`` (both inclusive), ``anchor_text, gated, lines`` (those of the segment).

    Segment i starts at ``greatest(a_i - 2, i)`` and ends before the next; a file without an anchor is one segment. Lines before the first
    start belong to none, and a file without lines has no segment.
    """
    files = marked(files, required, copies).where(F.size("lines") > 0)
    starts = F.transform("anchor_lines", lambda a, i: F.greatest(a - LOOK_BACK, i))
    files = files.withColumn("starts", F.when(F.col("anchor_text").isNull(), F.array(F.lit(0))).otherwise(starts))
    files = files.withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines"))))
    # For posexplode Spark would add a filter on the size of "starts", push it down and search each file's header twice.
    each = files.select("*", F.posexplode_outer("starts").alias("segment_index", "start_line")).where("segment_index IS NOT NULL")
    end = F.get("ends", F.col("segment_index"))
    return each.select(
        "source_file", "segment_index", "start_line", (end - 1).alias("end_line"), "anchor_text", F.col("anchor_text").isNull().alias("gated"),
        F.slice("lines", F.col("start_line") + 1, end - F.col("start_line")).alias("lines"),
    )


def anchor_text(lines: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES) -> DataFrame:
    """``source_file, anchor_text``: files without one have no row."""
    return marked(files_of(lines), required, copies).where("anchor_text IS NOT NULL").select("source_file", "anchor_text")


def anchors(lines: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES) -> DataFrame:
    """``source_file, line_no, anchor_no`` (from 0), ``anchor_text``"""
    return marked(files_of(lines), required, copies).select("source_file", F.posexplode("anchor_lines").alias("anchor_no", "line_no"), "anchor_text")


def segments(lines: DataFrame, required: Sequence[str] = REQUIRED, copies: int = LEAST_COPIES) -> DataFrame:
    """The bounds that :func:`cut` finds, for lines in rows."""
    return cut(files_of(lines), required, copies).drop("lines")


def assigned(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every line that belongs to a segment, with ``segment_index``: a running count of starts instead of a range join."""
    starts = bounds.select("source_file", F.col("start_line").alias("line_no"), F.lit(1).alias("starts"))
    w = Window.partitionBy("source_file").orderBy("line_no")
    marked = lines.join(starts, ["source_file", "line_no"], "left").withColumn("segment_index", (F.sum(F.coalesce("starts", F.lit(0))).over(w) - 1).cast("int"))
    return marked.where("segment_index >= 0").drop("starts")


def segment_flags(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """``source_file, segment_index, matched_subject, matched_service_to``"""
    return assigned(lines, bounds).groupBy("source_file", "segment_index").agg(
        F.bool_or(F.col("text").rlike(SUBJECT_WORD)).alias("matched_subject"), F.bool_or(F.col("text").rlike(SERVICE_TO)).alias("matched_service_to"),
    )


def least_plausibility(lines: Column) -> Column:
    """The least ``min_plausibility`` of an array of lines that are not blank; 1 without any."""
    scores = F.transform(F.filter(lines, lambda x: F.length(ws_strip(x["text"])) > 0), lambda x: x["min_plausibility"])
    return F.coalesce(F.array_min(scores), F.lit(1.0))


def segment_lines(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """``source_file, segment_index, lines`` (in order) and ``min_plausibility`` if the lines have one."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    extra = [F.coalesce(F.min(F.when(F.length(ws_strip("text")) > 0, F.col("min_plausibility"))), F.lit(1.0)).alias("min_plausibility")] if "min_plausibility" in lines.columns else []
    return assigned(lines, bounds).groupBy("source_file", "segment_index").agg(F.transform(parts, lambda x: x["text"]).alias("lines"), *extra)
