"""Drafts as word-processor files and PDF."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@dataclass(frozen=True)
class Layout:
    font: str = "Noto Sans Devanagari"
    size_pt: int = 12
    margin_cm: float = 2.5
    line_spacing: float = 1.5


class PdfUnavailable(RuntimeError):
    """No converter is installed."""


class PdfFailed(RuntimeError):
    """The converter is there and gave no PDF."""


def paragraphs(draft: str) -> list[list[str]]:
    """Paragraphs stand between empty lines; each is the list of its lines."""
    return [p.split("\n") for p in draft.strip().split("\n\n")]


def document_xml(draft: str, layout: Layout) -> str:
    name, half, twips = quoteattr(layout.font), 2 * layout.size_pt, round(layout.margin_cm / 2.54 * 1440)
    run = f'<w:rPr><w:rFonts w:ascii={name} w:hAnsi={name} w:cs={name} w:eastAsia={name}/><w:sz w:val="{half}"/><w:szCs w:val="{half}"/></w:rPr>'
    spacing = f'<w:pPr><w:spacing w:after="{20 * layout.size_pt}" w:line="{round(240 * layout.line_spacing)}" w:lineRule="auto"/></w:pPr>'
    body = []
    for lines in paragraphs(draft):
        runs = "<w:r><w:br/></w:r>".join(f'<w:r>{run}<w:t xml:space="preserve">{escape(x)}</w:t></w:r>' for x in lines)
        body.append(f"<w:p>{spacing}{runs}</w:p>")
    page = f'<w:sectPr><w:pgMar w:top="{twips}" w:right="{twips}" w:bottom="{twips}" w:left="{twips}" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{MAIN}"><w:body>{"".join(body)}{page}</w:body></w:document>'


def docx_bytes(draft: str, layout: Layout = Layout()) -> bytes:
    """The file's content. Control signs, which XML can't hold, are left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", document_xml(NOT_XML.sub("", draft), layout))):
            z.writestr(name, content)
    return out.getvalue()


@F.pandas_udf(BinaryType())
def docx_column(draft: pd.Series) -> pd.Series:
    """A word-processor file for each draft, in the tasks; null for null."""
    return draft.map(docx_bytes, na_action="ignore")


def write_docx(draft: str, path: str | Path, layout: Layout = Layout()) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(docx_bytes(draft, layout))
    return path


def write_pdf(draft: str, path: str | Path, layout: Layout = Layout(), converter: str | None = None, timeout: float = 90) -> Path:
    """By an office program, with a profile of its own for each call, so that calls don't wait for each other."""
    program = converter or shutil.which("soffice") or shutil.which("libreoffice")
    if not program:
        raise PdfUnavailable("no office program is installed")
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory() as folder:
        source = write_docx(draft, Path(folder) / "draft.docx", layout)
        command = [program, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", folder, str(source)]
        try:
            done = subprocess.run(command, capture_output=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise PdfFailed(str(e)) from e
        made = source.with_suffix(".pdf")
        if done.returncode or not made.exists():
            raise PdfFailed(done.stderr.decode("utf-8", "replace")[-1000:])
        shutil.move(made, path)
    return path
