"""The service over HTTP, with the standard library: JSON in, JSON out."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Lock
from urllib.parse import parse_qs, unquote, urlparse

from ..operators.export import PdfFailed, PdfUnavailable
from .service import BadRequest, NotFound, Service

Route = tuple[str, str, Callable]


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # what a page shows


def exported(write, draft: str, suffix: str) -> bytes:
    with tempfile.TemporaryDirectory() as folder:
        return write(draft, str(Path(folder) / f"letter.{suffix}")).read_bytes()


PAGE = b"""<!doctype html><meta charset="utf-8"><title>Letters</title>
<style>body{font:16px sans-serif;max-width:50em;margin:2em auto}textarea{width:100%}pre{white-space:pre-wrap;background:#f4f4f4;padding:1em}</style>
<h1>Letters</h1>
<form id="search"><input name="q" placeholder="search" required> <button>Search</button></form>
<form id="draft"><textarea name="request" rows="4" placeholder="what to write" required></textarea><select name="department"><option value="">any department</option></select>
<select name="letter_type"><option value="">any type</option></select> <button>Draft</button></form><pre id="out"></pre>
<script>
const out = document.getElementById("out"), show = async r => out.textContent = JSON.stringify(await r.json(), null, 2);
const fill = async (path, name) => { for (const v of await (await fetch(path)).json()) document.querySelector(`[name=${name}]`).add(new Option(v)); };
fill("/api/departments", "department"); fill("/api/letter-types", "letter_type");
document.getElementById("search").onsubmit = e => { e.preventDefault(); fetch("/api/admin/search?" + new URLSearchParams(new FormData(e.target))).then(show); };
document.getElementById("draft").onsubmit = e => { e.preventDefault(); fetch("/api/generate", {method: "POST", body: JSON.stringify(Object.fromEntries(new FormData(e.target)))}).then(show); };
</script>
"""

#: method, path (named parts in braces), answer from (service, parts, query, body)
ROUTES: list[Route] = [
    ("GET", "/api/departments", lambda s, p, q, b: s.departments()),
    ("GET", "/api/letter-types", lambda s, p, q, b: s.letter_types()),
    ("POST", "/api/generate", lambda s, p, q, b: {k: v for k, v in s.generate(b["request"], b.get("department"), b.get("letter_type"), b.get("facts"), b.get("top_k")).items() if k != "messages"}),
    ("POST", "/api/export/docx", lambda s, p, q, b: exported(s.export_docx, b["draft"], "docx")),
    ("POST", "/api/export/pdf", lambda s, p, q, b: exported(s.export_pdf, b["draft"], "pdf")),
    ("GET", "/api/admin/documents", lambda s, p, q, b: rows(s.documents(from_source=True))),
    ("GET", "/api/admin/documents/{id}", lambda s, p, q, b: rows(s.document(p["id"]))),
    ("DELETE", "/api/admin/documents/{id}", lambda s, p, q, b: s.delete_document(p["id"])),
    ("POST", "/api/admin/upload", lambda s, p, q, b: s.upload(q["department"], q["office"], q["filename"], b)),
    ("POST", "/api/admin/reindex", lambda s, p, q, b: s.reindex()),
    ("GET", "/api/admin/letters", lambda s, p, q, b: rows(s.letters(q.get("department")))),
    ("DELETE", "/api/admin/letters/{id}", lambda s, p, q, b: s.delete_letter(p["id"])),
    ("PATCH", "/api/admin/letters/{id}/metadata", lambda s, p, q, b: s.patch_metadata(p["id"], **b)),
    ("GET", "/api/admin/search", lambda s, p, q, b: rows(s.search(q["q"], int(q.get("top_k", 10))).drop("embedding", "document", "extra"))),
]


def answer(service: Service, method: str, target: str, body: bytes) -> tuple[int, str, bytes]:
    """Status, content type and content."""
    url = urlparse(target)
    query = {k: v[-1] for k, v in parse_qs(url.query).items()}
    if (method, url.path) == ("GET", "/"):
        return 200, "text/html; charset=utf-8", PAGE
    for verb, path, act in ROUTES:
        match = re.fullmatch(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path), url.path)
        if verb == method and match:
            parts = {k: unquote(v) for k, v in match.groupdict().items()}
            try:
                given = body if path.endswith("/upload") else json.loads(body) if body else {}
                done = act(service, parts, query, given)
            except (BadRequest, KeyError, TypeError, ValueError) as e:
                return 400, "application/json", json.dumps({"detail": str(e)}).encode()
            except NotFound as e:
                return 404, "application/json", json.dumps({"detail": str(e)}).encode()
            except PdfUnavailable as e:
                return 503, "application/json", json.dumps({"detail": str(e)}).encode()
            except (PdfFailed, RuntimeError) as e:
                return 500, "application/json", json.dumps({"detail": str(e)}).encode()
            if isinstance(done, bytes):
                return 200, "application/octet-stream", done
            return 200, "application/json", json.dumps(done, ensure_ascii=False, default=str).encode()
    return 404, "application/json", b'{"detail": "no such path"}'


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``. Requests that change the store wait for each other: it has one writer."""
    writing = Lock()

    class Handler(BaseHTTPRequestHandler):
        def act(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.command == "GET":
                status, kind, content = answer(service, self.command, self.path, body)
            else:
                with writing:
                    status, kind, content = answer(service, self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = do_PATCH = do_DELETE = act

    return ThreadingHTTPServer((host, port), Handler)
