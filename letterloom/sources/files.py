"""Scans: a folder tree of letters, as files, runs, lines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, text_lines
from ..operators.fonts import KEYS, grouped_lines

SUFFIXES = (".docx", ".pdf", ".txt")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RUNS = "source_file string, line_no int, run_no int, text string, font_name string, page_break_before boolean"
#: Lines with their runs, as a reader gives them: of one line all runs stand together.
LINES = "source_file string, line_no int, runs array<struct<run_no: int, text: string, font_name: string>>, page_break_before boolean, ocr_plausibility double"
RUN = pa.struct([("run_no", pa.int32()), ("text", pa.string()), ("font_name", pa.string())])
LEAST_TEXT = 20  # signs on a page, under which its text layer is not used


class ExtractorUnavailable(RuntimeError):
    """A format needs a callable that was not given."""


def scan(spark: SparkSession, root: str, only: str | Sequence[str] | None = None) -> DataFrame:
    """Files under ``root`` with a known suffix, none of them in a ``.meta`` folder: ``source_file`` (relative), ``suffix, department, office, stem, length, content, modified``.

    ``only`` is the relative path of one file, or of some: nothing else is listed or read then. ``content`` is only read where it is used. Use ``orderBy('source_file')`` where order matters. The file source skips files of no bytes; their
    names come from its listing and join by union, without content.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.read.schema(schema).format("binaryFile")
    exact = lambda name: re.sub(r"([\\{}\[\]*?])", r"\\\1", name)  # noqa: E731  a path that is loaded is a pattern
    some = [only] if isinstance(only, str) else only
    files = reader.load([f"{root.rstrip('/')}/{exact(x)}" for x in some]) if some is not None else reader.option("recursiveFileLookup", True).load(root)
    top = urlparse(base).path
    listed = [(f"{base}/{unquote(urlparse(f).path)[len(top) + 1:]}",) for f in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    files = files.select("path", "content", "length", F.col("modificationTime").alias("modified")).unionByName(empty.select("path", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified")))
    rel = F.substring("path", len(base) + 2, 1 << 20)
    files = files.select(rel.alias("source_file"), F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1)).alias("suffix"), "content", "length", "modified")
    files = files.where(F.col("suffix").isin(*SUFFIXES) & ~F.array_contains(F.split("source_file", "/"), ".meta"))
    return files.select("source_file", "suffix", *path_fields("source_file"), "length", "content", "modified")


def path_fields(relative: Column | str) -> list[Column]:
    """``department`` is the first part, ``office`` the second if a file follows it, else ``unknown``; ``stem`` is the name without its suffix."""
    parts = F.split(col(relative), "/")
    return [
        F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.lit("unknown")).alias("department"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("unknown").alias("office"),
        F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*\z", "").alias("stem"),
    ]


def txt_lines(files: DataFrame) -> DataFrame:
    """One row per text file with the array ``lines`` of its lines that are not blank."""
    return files.where("suffix = '.txt'").select("source_file", text_lines(F.decode("content", "UTF-8")).alias("lines"))


def docx_lines(content: bytes) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """Paragraphs in document order, those of tables cell by cell, as ``(runs, has a page break)``.

    Body paragraphs stay if they have text or a page break, those of tables if they have text. Each table cell counts once,
    also where it is merged over several columns.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for block in body if body is not None else ():
        if block.tag == f"{W}p":
            runs, breaks = paragraph(block)
            if breaks or "".join(t for t, _ in runs).strip():
                yield runs, breaks
        elif block.tag == f"{W}tbl":
            for cell in block.findall(f"{W}tr/{W}tc"):
                for p in cell.findall(f"{W}p"):
                    runs, breaks = paragraph(p)
                    if "".join(t for t, _ in runs).strip():
                        yield runs, breaks


def paragraph(p: ElementTree.Element) -> tuple[list[tuple[str, str | None]], bool]:
    runs, breaks = [], False
    for r in p.findall(f"{W}r"):
        fonts, text = r.find(f"{W}rPr/{W}rFonts"), []
        for x in r:
            if x.tag == f"{W}t":
                text.append(x.text or "")
            elif x.tag == f"{W}tab":
                text.append("\t")
            elif x.tag == f"{W}br" and x.get(f"{W}type") == "page":
                breaks = True
            elif x.tag in (f"{W}br", f"{W}cr"):
                text.append("\n")
        runs.append(("".join(text), fonts.get(f"{W}ascii") if fonts is not None else None))
    return runs, breaks


#: ``(runs, page_break_before, ocr_plausibility)`` of a line; a run is ``(text, font)``.
Line = tuple[list[tuple[str, str | None]], bool, float | None]


def read_lines(files: DataFrame, lines: Callable[[str, bytes], Iterator[Line]]) -> DataFrame:
    """``LINES`` of files ``source_file, content``: each is read once."""

    def batch(name: str, found: list[Line]) -> pa.RecordBatch:
        ends = [0]
        for runs, _, _ in found:
            ends.append(ends[-1] + len(runs))
        flat = [{"run_no": j, "text": t, "font_name": f} for runs, _, _ in found for j, (t, f) in enumerate(runs)]
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, RUN))
        columns = {"source_file": pa.array([name] * len(found), pa.string()), "line_no": pa.array(range(len(found)), pa.int32()), "runs": held}
        return pa.record_batch(columns | {"page_break_before": pa.array([b for _, b, _ in found], pa.bool_()), "ocr_plausibility": pa.array([s for _, _, s in found], pa.float64())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, content in zip(part.column("source_file").to_pylist(), part.column("content"), strict=True):
                yield batch(name, list(lines(name, content.as_py())))

    return files.select("source_file", "content").mapInArrow(read, LINES)


def runs_of(lines: DataFrame, *more: str) -> DataFrame:
    """A row for each run."""
    each = lines.select("source_file", "line_no", F.explode("runs").alias("r"), "page_break_before", *more)
    return each.select("source_file", "line_no", "r.run_no", "r.text", "r.font_name", "page_break_before", *more)


def docx_files(files: DataFrame) -> DataFrame:
    """Lines of word-processor files with their runs, at least one (empty) for each."""
    return read_lines(files.where("suffix = '.docx'"), lambda _, content: ((runs or [("", None)], b, None) for runs, b in docx_lines(content)))


def docx_runs(files: DataFrame) -> DataFrame:
    """The same as a row for each run."""
    return runs_of(docx_files(files))


#: Gives a PDF's pages, each a list of lines, each a list of ``(text, font)``.
Extractor = Callable[[bytes], list[list[list[tuple[str, str | None]]]]]
#: Gives a page's text and mean confidence (0 to 100).
Ocr = Callable[[bytes, int], tuple[str, float]]


def pdf_files(files: DataFrame, extract: Extractor | None, ocr: Ocr | None = None) -> DataFrame:
    """Lines of PDF files with their runs, and ``ocr_plausibility`` for lines read by OCR, which stands in where a page has under 20 signs of text."""

    def read(name: str, content: bytes) -> Iterator[Line]:
        if extract is None:
            raise ExtractorUnavailable(f"{name}: no PDF extractor was given")
        for page_no, page in enumerate(extract(content)):
            lines, score = [x for x in page if "".join(t for t, _ in x).strip()], None
            if sum(len("".join(t for t, _ in x).strip()) for x in lines) < LEAST_TEXT and ocr is not None:
                text, confidence = ocr(content, page_no)
                lines, score = [[(x, None)] for x in text.splitlines() if x.strip()], confidence / 100
            for first, line in enumerate(lines):
                yield line, first == 0, score

    return read_lines(files.where("suffix = '.pdf'"), read)


def pdf_runs(files: DataFrame, extract: Extractor | None, ocr: Ocr | None = None) -> DataFrame:
    """The same as a row for each run."""
    return runs_of(pdf_files(files, extract, ocr), "ocr_plausibility")


def decoded_lines(lines: DataFrame, table=KEYS) -> DataFrame:
    """``source_file, line_no, text, page_break_before, min_plausibility``: run groups decoded and joined; empty lines stay.

    Lines that a reader gives (:func:`docx_files`, :func:`pdf_files`) have their runs and need no shuffle; runs that are rows are collected by one.
    """
    keys = ["source_file", "line_no"]
    if "runs" not in lines.columns:
        ocr = F.first("ocr_plausibility") if "ocr_plausibility" in lines.columns else F.first(F.lit(None).cast("double"))
        runs = F.collect_list(F.struct("run_no", "text", "font_name"))
        lines = lines.groupBy(*keys).agg(runs.alias("runs"), F.bool_or("page_break_before").alias("page_break_before"), ocr.alias("ocr_plausibility"))
    done = grouped_lines(lines, table)
    return done.select(*keys, "text", "page_break_before", F.coalesce("ocr_plausibility", "min_plausibility").alias("min_plausibility"))


def sidecars(spark: SparkSession, path: str, schema: str = "letter_id string, department string, office string, letter_type string, subject string") -> DataFrame:
    """Override files, one JSON object each; fields that are absent are null. The id comes from the file's name if the object has none."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.meta)?(?:\.auto)?\.json\z", 1)
    return raw.withColumn("letter_id", F.coalesce("letter_id", name))
