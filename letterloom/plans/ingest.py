"""From files to letters: scan, decode, segment, clean, extract, correct. Reading has no side effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plausibility import needs_review
from ..functions.text import clean_lines, letter_id
from ..operators import long_files
from ..operators.embed import VectorCache, hash_embedding
from ..operators.fonts import KEYS
from ..operators.metadata import extract, with_overrides
from ..operators.segment import cut, files_of, least_plausibility
from ..sources import files as src


def letters_of_lines(lines: DataFrame, by_rows: bool = False) -> DataFrame:
    """``source_file, segment_index, lines, min_line_plausibility`` of decoded lines; segments are found before lines are cleaned.

    With ``by_rows`` no file is ever one row: only each letter is. ``lines`` should then be a table, as it is read several times.
    """
    lines = lines.select("source_file", "line_no", "text", "min_plausibility")
    if by_rows:
        each = F.array_sort(F.collect_list(F.struct("line_no", "text", "min_plausibility")))
        found = long_files.assigned(lines, long_files.segments(lines)).groupBy("source_file", "segment_index").agg(each.alias("lines"))
    else:
        found = cut(files_of(lines))
    return found.select("source_file", "segment_index", clean_lines(F.transform("lines", lambda x: x["text"])).alias("lines"), least_plausibility(F.col("lines")).alias("min_line_plausibility"))


def ingest(spark: SparkSession, root: str, overrides: DataFrame | None = None, pdf: src.Extractor | None = None, ocr: src.Ocr | None = None, table=KEYS, qualified: bool = False, only: str | Sequence[str] | None = None) -> DataFrame:
    """The ``letters`` relation of a folder tree, or of one file or some in it (``only``, relative paths).

    Text files are one letter each, never segmented or scored. ``letter_id`` is the file's stem and the segment's number; ``qualified`` takes the whole
    relative path instead of the stem, so that equal names in different folders stay apart.
    """
    return ingest_files(src.scan(spark, root, only), overrides, pdf, ocr, table, qualified)


def ingest_files(files: DataFrame, overrides: DataFrame | None = None, pdf: src.Extractor | None = None, ocr: src.Ocr | None = None, table=KEYS, qualified: bool = False, by_rows: bool = False) -> DataFrame:
    """:func:`ingest` of files that are rows already: ``source_file`` (relative), ``suffix, content``. See :func:`letters_of_lines` for ``by_rows``."""
    lines = src.docx_files(files)
    if pdf is not None:
        lines = lines.unionByName(src.pdf_files(files, pdf, ocr))
    parts = letters_of_lines(src.decoded_lines(lines, table), by_rows)
    plain = src.txt_lines(files).select("source_file", F.lit(0).alias("segment_index"), clean_lines("lines").alias("lines"), F.lit(1.0).alias("min_line_plausibility"))
    return finish(parts.unionByName(plain), overrides, qualified)


def finish(parts: DataFrame, overrides: DataFrame | None = None, qualified: bool = False) -> DataFrame:
    named = parts.select("*", *src.path_fields("source_file"))
    stem = F.regexp_replace("source_file", r"\.[^./]*\z", "") if qualified else F.col("stem")
    letters = extract(named.withColumn("letter_id", letter_id(stem, "segment_index")).withColumn("text", F.array_join("lines", "\n"))).drop("lines", "stem")
    letters = with_overrides(letters, overrides) if overrides is not None else letters
    return letters.withColumn("needs_review", needs_review("min_line_plausibility"))


def summary(letters: DataFrame) -> DataFrame:
    """``letters_found, letters_indexed, needs_review``"""
    return letters.agg(F.count("*").alias("letters_found"), F.countDistinct("letter_id").alias("letters_indexed"), F.coalesce(F.sum(F.col("needs_review").cast("long")), F.lit(0)).alias("needs_review"))


def document_rollup(letters: DataFrame) -> DataFrame:
    """Per file: how many segments, how many to review, department and office of the first segment."""
    return letters.groupBy("source_file").agg(
        F.count("*").alias("segment_count"), F.sum(F.col("needs_review").cast("long")).alias("needs_review_count"),
        F.min_by("department", "segment_index").alias("department"), F.min_by("office", "segment_index").alias("office"),
    )


def store_batch(letters: DataFrame, embedding=None, cache: VectorCache | None = None) -> DataFrame:
    """Letters as the store takes them: scalar metadata only, ``pos`` in order of file and segment. Texts that a ``cache`` knows don't reach the model."""
    letters = cache.attach(letters, "text", "_vector", embedding) if cache is not None else letters
    extra = F.map_filter(
        F.create_map(*[x for f in ("context_reference", "reference_number", "reference_date", "recipient_designation", "sender_designation") for x in (F.lit(f), F.col(f))]),
        lambda _, v: v.isNotNull(),
    )
    vector = F.col("_vector") if cache is not None else (embedding("text") if embedding is not None else hash_embedding("text")).cast("array<float>")
    return letters.select(
        F.struct("source_file", "segment_index").alias("pos"), "letter_id", F.col("text").alias("document"), "department", "office", "letter_type", "subject", "source_file", "needs_review", extra.alias("extra"), vector.alias("embedding"),
    )


def write_auto_metadata(letters: DataFrame, path: str) -> None:
    """The extracted fields, before corrections, as JSON lines. Only called where it is asked for: listing letters writes nothing."""
    letters.drop("text").write.mode("overwrite").json(path)
