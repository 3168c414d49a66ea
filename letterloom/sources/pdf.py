"""Readers of PDF files for :func:`.files.pdf_runs`, where the optional packages and programs are there: PyMuPDF for text layers and page images,
tesseract for OCR. Both run on the executors, so they have to be installed there."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess

from ..functions.plausibility import mean_confidence
from .files import Extractor, ExtractorUnavailable, Ocr

DPI = 300
LANGUAGES = "hin+eng"


def text_layer(content: bytes) -> list[list[list[tuple[str, str | None]]]]:
    """Pages, lines and spans of the text layer, with the spans' fonts."""
    try:
        import pymupdf
    except ImportError as e:
        raise ExtractorUnavailable("reading PDF files needs the package pymupdf") from e
    with pymupdf.open(stream=content, filetype="pdf") as document:
        return [
            [[(span["text"], span["font"]) for span in line["spans"]] for block in page.get_text("dict")["blocks"] for line in block.get("lines", ())]
            for page in document
        ]


def tesseract(image: bytes, *options: str) -> str:
    if shutil.which("tesseract") is None:
        raise ExtractorUnavailable("OCR needs the program tesseract")
    return subprocess.run(["tesseract", "stdin", "stdout", "-l", LANGUAGES, *options], input=image, capture_output=True, check=True).stdout.decode("utf-8", "replace")


def words_of(table: str) -> list[tuple[str, float]]:
    """Texts and confidences from tesseract's table (tab-separated; the first row names the columns)."""
    head, *rows = [line.split("\t") for line in table.splitlines()] or [[]]
    return [(r[head.index("text")], float(r[head.index("conf")])) for r in rows if len(r) == len(head)]


def ocr(content: bytes, page_no: int) -> tuple[str, float]:
    """The page's text, and the mean confidence of its words."""
    try:
        import pymupdf
    except ImportError as e:
        raise ExtractorUnavailable("rendering PDF pages needs the package pymupdf") from e
    with pymupdf.open(stream=content, filetype="pdf") as document:
        image = document[page_no].get_pixmap(dpi=DPI).tobytes("png")
    return tesseract(image), mean_confidence(words_of(tesseract(image, "tsv")))


def available() -> tuple[Extractor | None, Ocr | None]:
    """What this machine can do: a reader of text layers, and OCR behind it."""
    if importlib.util.find_spec("pymupdf") is None:
        return None, None
    return text_layer, ocr if shutil.which("tesseract") else None
