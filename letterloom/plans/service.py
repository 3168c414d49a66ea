"""The operations that a web front end or a command line calls."""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import encode_path, snippet
from ..operators.embed import Embedder, HashEmbedder, VectorCache, embedding, hash_embedding, make_embedder
from ..operators.export import Layout, write_docx, write_pdf
from ..operators.generate import build_messages, reference_section
from ..operators.index import TermIndex
from ..operators.metadata import with_overrides
from ..operators.retrieve import retrieve, two_stage
from ..operators.store import RETRIES, ConcurrentChange, Store, build_filter
from ..ship import ship
from ..sources.files import ExtractorUnavailable, SUFFIXES, scan, sidecars
from ..sources.state import FILES, FileState, difference, settled
from .ingest import document_rollup, ingest, store_batch, summary

SLUG = re.compile(r"[A-Za-z0-9_-]+\Z")
EDITABLE = ("department", "office", "letter_type", "subject")


class BadRequest(ValueError):
    pass


class NotFound(LookupError):
    pass


@dataclass(frozen=True)
class Settings:
    data_dir: str
    store_dir: str
    top_k: int = 5
    temperature: float = 0.2
    model: str = "default"
    layout: Layout = field(default_factory=Layout)
    embedding_backend: str = "hash"
    embedding_model: str = "default"
    host: str = "http://localhost:11434"
    context: int = 8192

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        e = os.environ if env is None else env
        layout = Layout(e.get("DOCX_FONT_NAME", Layout.font), int(e.get("DOCX_FONT_SIZE_PT", Layout.size_pt)), float(e.get("DOCX_MARGIN_CM", Layout.margin_cm)), float(e.get("DOCX_LINE_SPACING", Layout.line_spacing)))
        return cls(e.get("DATA_DIR", "data/letters"), e.get("STORE_DIR", "letter_store"), int(e.get("TOP_K", "5")), float(e.get("GENERATION_TEMPERATURE", "0.2")), e.get("CHAT_MODEL", "default"), layout,
                   e.get("EMBEDDING_BACKEND", "hash"), e.get("EMBEDDING_MODEL", "default"), e.get("MODEL_HOST", cls.host), int(e.get("MODEL_CONTEXT", str(cls.context))))

    def embedder(self) -> Embedder:
        """The one that the settings name."""
        options = {"hash": {}, "http": {"model_name": self.embedding_model, "host": self.host, "context": self.context}, "local": {"model_name": self.embedding_model}}
        return make_embedder(self.embedding_backend, **options.get(self.embedding_backend, {}))


def doc_id_of(relative: str) -> str:
    return base64.urlsafe_b64encode(relative.encode()).decode()


def path_of(root: Path, doc_id: str) -> Path:
    """The file of a document id, which must lie inside ``root``."""
    try:
        relative = base64.b64decode(doc_id.encode("ascii"), altchars=b"-_", validate=True).decode()
        path = (root / relative).resolve()
    except (ValueError, OSError) as e:
        raise BadRequest("not a document id") from e
    if not path.is_relative_to(root.resolve()):
        raise BadRequest("outside the data folder")
    return path


def whole(path: Path, content: bytes) -> None:
    """Write a file under another name and put it in place whole."""
    staged = path.with_name(f".{uuid.uuid4().hex}.tmp")
    staged.write_bytes(content)
    staged.replace(path)


class Service:
    """Overrides live beside the letters in ``.meta``; everything else that is asked often comes from the store.

    What changes a file and the store writes its intent down first (a small file in the store's folder) and removes it when both are done. Intents that are
    found when a service opens are carried out: a file that is in place gets its letters, one that is not leaves none; a deletion is finished.
    """

    def __init__(self, spark: SparkSession, settings: Settings, embedder: Embedder | None = None, chat=None, pdf=None, ocr=None):
        self.spark, self.settings, self.embedder, self.chat, self.pdf, self.ocr = spark, settings, embedder or settings.embedder(), chat, pdf, ocr
        ship(spark)
        self.root = Path(settings.data_dir)
        self.store = Store(spark, settings.store_dir, self.embedder.model_name, self.embedder.dimension())
        self.state = FileState(spark, f"{settings.store_dir}/files")
        self.vectors = None if isinstance(self.embedder, HashEmbedder) else VectorCache(spark, f"{settings.store_dir}/vectors", self.embedder.model_name)
        self.terms = TermIndex(self.store, f"{settings.store_dir}/terms")
        self.intents = Path(settings.store_dir) / "intents"
        self._replay()

    # Changes of a file and the store together.
    @contextmanager
    def _intent(self, **what: str):
        self.intents.mkdir(parents=True, exist_ok=True)
        path = self.intents / f"{uuid.uuid4().hex}.json"
        whole(path, json.dumps(what).encode())
        yield
        path.unlink()

    def _replay(self) -> None:
        for path in sorted(self.intents.glob("*.json")) if self.intents.is_dir() else ():
            what = json.loads(path.read_text())
            source = what["source_file"]
            if what["do"] == "delete":
                self._delete_file(source)
            elif what["do"] == "patch":
                if (self.root / source).exists():
                    self._apply(what["letter_id"])
            elif (self.root / source).is_file():
                self._take(source)
            path.unlink()

    def _vector(self):
        return (lambda c: hash_embedding(c, self.embedder.dimension())) if isinstance(self.embedder, HashEmbedder) else embedding(self.embedder)

    def _overrides(self) -> DataFrame | None:
        meta = self.root / ".meta"
        return sidecars(self.spark, str(meta)) if meta.is_dir() and any(meta.glob("*.json")) else None

    def letters_from_source(self, only: str | Sequence[str] | None = None) -> DataFrame:
        """Of the whole tree, or of one file or some (relative paths)."""
        return ingest(self.spark, str(self.root), self._overrides(), self.pdf, self.ocr, only=only)

    def _batch(self, letters: DataFrame) -> DataFrame:
        return store_batch(letters, self._vector(), self.vectors)

    def _rows(self) -> DataFrame:
        return self.store.rows().withColumn("text", F.col("document"))

    # Catalogue.
    def departments(self) -> list[str]:
        return self.store.distinct("department")

    def letter_types(self) -> list[str]:
        return self.store.distinct("letter_type")

    # Drafting.
    def generate(self, request: str, department: str | None = None, letter_type: str | None = None, facts: dict[str, str] | None = None, top_k: int | None = None) -> dict:
        [vector] = self.embedder.embed([request])
        hits, used, detected = two_stage(self._rows(), request, vector, top_k or self.settings.top_k, department, letter_type, terms=self.terms)
        hits = hits.persist()
        try:
            messages = build_messages(request, used, letter_type, reference_section(hits).first().references, facts)
            shown = hits.orderBy("rank").select("letter_id", "department", "letter_type", "subject", snippet("text").alias("snippet")).collect()
        finally:
            hits.unpersist()
        draft = self.chat.chat(self.settings.model, messages, self.settings.temperature)
        return {"draft": draft, "department_used": used, "department_auto_detected": bool(detected and used), "letter_type_used": letter_type, "references": [r.asDict() for r in shown], "messages": messages}

    def export_docx(self, draft: str, path: str) -> Path:
        return write_docx(draft, path, self.settings.layout)

    def export_pdf(self, draft: str, path: str) -> Path:
        return write_pdf(draft, path, self.settings.layout)

    # Administration.
    def documents(self, from_source: bool = False) -> DataFrame:
        rows = self.letters_from_source() if from_source else self.store.rows().withColumn("segment_index", F.col("ord"))
        return document_rollup(rows).withColumn("doc_id", encode_path("source_file")).orderBy("source_file")

    def document(self, doc_id: str) -> DataFrame:
        path = path_of(self.root, doc_id)
        if not path.is_file():
            raise NotFound(doc_id)
        return self.letters_from_source(str(path.relative_to(self.root.resolve()))).orderBy("segment_index")

    def delete_document(self, doc_id: str) -> None:
        path = path_of(self.root, doc_id)
        if not path.is_file():
            raise NotFound(doc_id)
        source = str(path.relative_to(self.root.resolve()))
        with self._intent(do="delete", source_file=source):
            self._delete_file(source)

    def _delete_file(self, source: str) -> None:
        self.store.delete_where({"source_file": source})
        for sidecar in (self.root / ".meta").glob("*.json"):
            if sidecar.name.startswith(f"{Path(source).stem}__seg"):
                sidecar.unlink()
        (self.root / source).unlink(missing_ok=True)

    def upload(self, department: str, office: str, filename: str, content: bytes) -> dict:
        name = Path(filename).name
        if not (SLUG.match(department) and SLUG.match(office)):
            raise BadRequest("department and office take letters, digits, _ and -")
        if Path(name).suffix.lower() not in SUFFIXES:
            raise BadRequest(f"suffix must be one of {', '.join(SUFFIXES)}")
        if Path(name).suffix.lower() == ".pdf" and self.pdf is None:
            raise ExtractorUnavailable(f"{name}: no PDF extractor was given")
        path = self.root / department / office / name
        path.parent.mkdir(parents=True, exist_ok=True)
        source = str(path.relative_to(self.root))
        with self._intent(do="upload", source_file=source):
            whole(path, content)
            return self._take(source)

    def _take(self, source: str) -> dict:
        """The letters of a file into the store; segments that it no longer has go."""
        letters = self.letters_from_source(source).persist()
        try:
            found = summary(letters).first().asDict()
            gone = self.store.rows().where(F.col("source_file") == source).join(letters.select("letter_id"), "letter_id", "left_anti")
            self.store.delete_ids([r.letter_id for r in gone.select("letter_id").collect()])
            self.store.upsert(self._batch(letters))
            return found
        finally:
            letters.unpersist()

    def _listing(self) -> DataFrame:
        """``source_file, stem, suffix, length, modified`` of the tree, without content."""
        return scan(self.spark, str(self.root)).select("source_file", "stem", "suffix", "length", "modified")

    def _sidecar_times(self) -> DataFrame:
        """Override files as rows of the file state, so that a change of one is seen; bounded by the corrections made by hand."""
        meta = self.root / ".meta"
        found = [(f".meta/{p.name}", p.stat().st_size, datetime.fromtimestamp(p.stat().st_mtime)) for p in sorted(meta.glob("*.json"))] if meta.is_dir() else []
        return self.spark.createDataFrame(found, "source_file string, length bigint, modified timestamp")

    def reindex(self, prune: bool = False, full: bool = False) -> dict:
        """Bring the store up to date with the tree. The summary of all letters; ``files_skipped``: PDFs without a callable that reads them, whose letters stay when pruning; and how many
        files were ``added``, ``changed``, ``gone``, read again for other reasons (``again``) and left alone (``same``).

        Only files that were added or changed are read, with those that share their stems (and so ids) and those whose overrides or stored letters have
        changed; of an unchanged tree no content is read. ``full`` reads all.
        """
        spark, listing = self.spark, self._listing().persist()
        try:
            left_out = [r.source_file for r in listing.where(F.lit(self.pdf is None) & (F.col("suffix") == ".pdf")).select("source_file").collect()]
            now = listing.where(~F.col("source_file").isin(left_out)) if left_out else listing
            before = self.state.read()
            full = full or before is None
            before = spark.createDataFrame([], FILES) if full else before.where(~F.col("source_file").isin(left_out)) if left_out else before
            marks = self._sidecar_times()
            found = difference(now.unionByName(marks.withColumn("stem", F.lit(None).cast("string")).withColumn("suffix", F.lit(None).cast("string"))), before)
            found = settled(found, lambda names: self._content(names)).persist()
            changed = found.where("status IN ('added', 'changed', 'gone')")
            # Names that share a stem share ids; an override names its letter.
            name = F.element_at(F.split("source_file", "/"), -1)
            stem = F.when(F.col("source_file").startswith(".meta/"), F.regexp_replace(name, r"__seg\d+(?:\.meta)?(?:\.auto)?\.json\z", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""))
            stems = changed.select(stem.alias("stem")).distinct()
            stored = before.where(F.size("letters") > 0).select("source_file", F.explode("letters").alias("letter_id")).join(self.store.rows().select("letter_id"), "letter_id", "left_anti").select("source_file")
            due = now.join(stems, "stem", "left_semi").select("source_file").union(now.join(stored, "source_file", "left_semi").select("source_file")).distinct()
            names = sorted(r.source_file for r in due.collect())
            counts = {r.status: r["count"] for r in found.where("source_file NOT LIKE '.meta/%'").groupBy("status").count().collect()}
            told = {"files_skipped": len(left_out), "added": counts.get("added", 0), "changed": counts.get("changed", 0), "gone": counts.get("gone", 0)}
            told |= {"again": len(names) - told["added"] - told["changed"], "same": counts.get("same", 0) + counts.get("touched", 0)}
            letters = self.letters_from_source(names if not full else None).persist() if names else None
            try:
                state = self._new_state(now, marks, found, before, letters, names)
                if letters is not None:
                    self.store.upsert(self._batch(letters))
                if prune:
                    self.store.keep_ids(state.select(F.explode("letters").alias("letter_id")).union(self.store.rows().where(F.col("source_file").isin(left_out)).select("letter_id")).distinct())
                if full or names or told["gone"] or counts.get("touched") or found.where("status NOT IN ('same')").limit(1).count():
                    self.state.write(state)
                ids = state.select(F.explode("letters").alias("letter_id"))
                every = ids.agg(F.count("*").alias("letters_found"), F.countDistinct("letter_id").alias("letters_indexed")).first().asDict()
                return every | {"needs_review": state.agg(F.coalesce(F.sum("n_review"), F.lit(0))).first()[0]} | told
            finally:
                if letters is not None:
                    letters.unpersist()
                found.unpersist()
        finally:
            listing.unpersist()

    def _content(self, names: list[str]) -> DataFrame:
        """``source_file, content`` of some files, overrides among them."""
        own = [n for n in names if not n.startswith(".meta/")]
        rest = [(n, (self.root / n).read_bytes()) for n in names if n.startswith(".meta/")]
        read = self.spark.createDataFrame(rest, "source_file string, content binary")
        return scan(self.spark, str(self.root), own).select("source_file", "content").unionByName(read) if own else read

    def _new_state(self, now: DataFrame, marks: DataFrame, found: DataFrame, before: DataFrame, letters: DataFrame | None, names: list[str]) -> DataFrame:
        """The file state after a reindex: new rows for what was read, the earlier ones for the rest."""
        old = before.select("source_file", F.col("digest").alias("_digest"), F.col("letters").alias("_letters"), F.col("n_review").alias("_n"))
        kept = now.select("source_file", "length", "modified").unionByName(marks).join(old, "source_file", "left")
        if letters is None:
            return kept.select("source_file", "length", "modified", F.col("_digest").alias("digest"), F.coalesce("_letters", F.array().cast("array<string>")).alias("letters"), F.coalesce("_n", F.lit(0)).alias("n_review"))
        read = letters.groupBy("source_file").agg(F.sort_array(F.collect_list("letter_id")).alias("letters"), F.sum(F.col("needs_review").cast("long")).alias("n_review"))  # the letters of one file
        fresh = found.where("status IN ('added', 'changed')").select("source_file")
        digests = self._digests([r.source_file for r in fresh.collect()], full=not before.take(1))
        again = self.spark.createDataFrame([(n,) for n in names], "source_file string").withColumn("_again", F.lit(True))
        joined = kept.join(read, "source_file", "left").join(digests, "source_file", "left").join(again, "source_file", "left")
        new = F.col("_again").isNotNull()
        return joined.select(
            "source_file", "length", "modified", F.coalesce("digest", "_digest").alias("digest"),
            F.coalesce(F.when(new, F.col("letters")).otherwise(F.col("_letters")), F.array().cast("array<string>")).alias("letters"), F.coalesce(F.when(new, F.col("n_review")).otherwise(F.col("_n")), F.lit(0)).alias("n_review"),
        )

    def _digests(self, names: list[str], full: bool) -> DataFrame:
        read = scan(self.spark, str(self.root)).select("source_file", "content") if full else self._content(names)
        return read.select("source_file", F.sha2("content", 256).alias("digest"))

    def letters(self, department: str | None = None) -> DataFrame:
        rows = self.store.find(build_filter(department))
        return rows.select("letter_id", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("department", "office")], "letter_type", "subject", "source_file", F.coalesce("needs_review", F.lit(False)).alias("needs_review"))

    def delete_letter(self, letter_id: str) -> None:
        if not self.store.get([letter_id]).count():
            raise NotFound(letter_id)
        self.store.delete_ids([letter_id])

    def patch_metadata(self, letter_id: str, **fields: str | None) -> None:
        """Fields that are None are left alone. The correction also lasts through a reindex."""
        if unknown := set(fields) - set(EDITABLE):
            raise BadRequest(f"unknown fields {sorted(unknown)}")
        row = self.store.get([letter_id])
        if not row.count():
            raise NotFound(letter_id)
        new = {k: v for k, v in fields.items() if v is not None}
        sidecar = self.root / ".meta" / f"{letter_id}.meta.json"
        sidecar.parent.mkdir(parents=True, exist_ok=True)
        held = json.loads(sidecar.read_text()) if sidecar.exists() else {}
        with self._intent(do="patch", source_file=f".meta/{sidecar.name}", letter_id=letter_id):
            whole(sidecar, json.dumps({**held, "letter_id": letter_id, **new}, ensure_ascii=False).encode())
            self._apply(letter_id)

    def _apply(self, letter_id: str) -> None:
        """The letter's override file on its row in the store, on the newest row if another writer changes it meanwhile."""
        held = json.loads((self.root / ".meta" / f"{letter_id}.meta.json").read_text())
        override = self.spark.createDataFrame([(letter_id, *[held.get(f) for f in EDITABLE])], "letter_id string, " + ", ".join(f"{f} string" for f in EDITABLE))
        for _ in range(RETRIES):
            seen = self.store.version()
            try:
                return self.store.upsert(with_overrides(self.store.get([letter_id]).drop("ord"), override), since=seen)
            except ConcurrentChange:
                continue
        raise ConcurrentChange(letter_id)

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        [vector] = self.embedder.embed([query])
        return retrieve(self._rows(), query, vector, top_k, terms=self.terms)
