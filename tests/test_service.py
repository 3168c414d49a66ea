"""From files to answers, through the service."""

import base64

import pytest

from letterloom.operators import export
from letterloom.operators.store import Store
from letterloom.plans.service import BadRequest, NotFound, Service, Settings, doc_id_of
from letterloom.sources import files
from letterloom.streaming.ingest import stream_into, text_file_stream

HEAD = "पत्रांक-----/दिनांक-----"
MANY = "\n\n".join(f"कार्यालय\n\nजिला {i}\n\n{HEAD}\n\nसेवा में,\n\nप्रबंधक {i}\n\nविषय: शिक्षक {i}" for i in range(4))


class Chat:
    def chat(self, model, messages, temperature):
        self.messages = messages
        return "draft"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("letters")
    export.write_docx(MANY, root / "education" / "cell" / "many.docx")
    (root / "revenue" / "desk").mkdir(parents=True)
    (root / "revenue" / "desk" / "tax.TXT").write_text("विषय: भूमि कर\nland tax due\n\n", encoding="utf-8")
    (root / "revenue" / "empty.txt").write_text("")
    (root / "top.txt").write_text("x")
    (root / "skip.pdf").write_bytes(b"%PDF")
    s = Service(spark, Settings(str(root), str(tmp_path_factory.mktemp("store") / "s")), chat=Chat())
    s.reindex()
    return s


def test_ingest(service):
    rows = {r.letter_id: r for r in service.letters_from_source().collect()}
    assert set(rows) == {"many__seg000", "many__seg001", "many__seg002", "many__seg003", "tax__seg000", "empty__seg000", "top__seg000"}
    assert rows["many__seg002"].subject == "शिक्षक 2" and rows["many__seg002"].recipient_designation == "प्रबंधक 2" and rows["many__seg002"].office == "cell"
    assert rows["empty__seg000"].text == "" and rows["empty__seg000"].office == "unknown" and rows["top__seg000"].department == "top.txt"
    assert rows["tax__seg000"].min_line_plausibility == 1.0 and not rows["tax__seg000"].needs_review


def test_catalogue_and_search(service):
    assert service.departments() == ["education", "revenue", "top.txt"] and "general_correspondence" in service.letter_types()
    assert service.search("land tax", 3).first().letter_id == "tax__seg000"
    assert {r.letter_id for r in service.letters("education").collect()} == {f"many__seg00{i}" for i in range(4)}


def test_generate(service):
    done = service.generate("land tax", "revenue", None, {"name": "A"}, 2)
    assert done["draft"] == "draft" and done["department_used"] == "revenue" and not done["department_auto_detected"]
    assert done["references"][0]["letter_id"] == "tax__seg000" and "name: A" in done["messages"][1]["content"]


def test_documents(service):
    docs = {r.source_file: r for r in service.documents().collect()}
    assert docs["education/cell/many.docx"].segment_count == 4
    assert service.document(doc_id_of("education/cell/many.docx")).count() == 4
    with pytest.raises(NotFound):
        service.document(doc_id_of("no.txt"))
    for bad in (base64.urlsafe_b64encode(b"../secret.txt").decode(), "%%%"):
        with pytest.raises(BadRequest):
            service.document(bad)


def test_change_and_delete(service):
    service.patch_metadata("many__seg001", department="fixed", subject=None)
    assert service.store.get(["many__seg001"]).first().department == "fixed"
    assert {r.letter_id: r.department for r in service.letters_from_source().collect()}["many__seg001"] == "fixed"
    assert service.store.get(["many__seg001"]).first().subject == "शिक्षक 1"
    with pytest.raises(NotFound):
        service.patch_metadata("nobody", department="x")
    with pytest.raises(BadRequest):
        service.patch_metadata("many__seg001", body="x")
    service.delete_letter("many__seg000")
    assert service.store.get(["many__seg000"]).count() == 0
    with pytest.raises(NotFound):
        service.delete_letter("many__seg000")
    service.reindex()
    assert service.store.get(["many__seg000"]).count() == 1


def test_upload_replaces_and_delete_removes(service):
    found = service.upload("health", "ward", "new.txt", "विषय: नया".encode())
    assert found["letters_found"] == 1 and service.store.get(["new__seg000"]).first().department == "health"
    for department, name in (("bad slug", "x.txt"), ("a\n", "x.txt"), ("a", "x.exe")):
        with pytest.raises(BadRequest):
            service.upload(department, "o", name, b"")
    service.delete_document(doc_id_of("health/ward/new.txt"))
    assert service.store.get(["new__seg000"]).count() == 0


def test_pdf_hooks(spark, service):
    scan = files.scan(spark, str(service.root))
    pages = [[[("a long line of text on the page", None)]], [[("x", None)]]]
    lines = files.decoded_lines(files.pdf_runs(scan, lambda b: pages, lambda b, n: (f"read {n}\n\nagain", 45.0))).orderBy("line_no").collect()
    assert [(r.text, r.page_break_before, r.min_plausibility) for r in lines] == [("a long line of text on the page", True, 1.0), ("read 1", True, 0.45), ("again", False, 0.45)]
    with pytest.raises(Exception, match="no PDF extractor"):
        files.pdf_runs(scan, None).count()


def test_stream(spark, tmp_path):
    (tmp_path / "in" / "d" / "o").mkdir(parents=True)
    (tmp_path / "in" / "d" / "o" / "a.txt").write_text("विषय: एक", encoding="utf-8")
    store = Store(spark, str(tmp_path / "s"), "hash-embedder", 64)
    for _ in range(2):
        q = stream_into(store, text_file_stream(spark, str(tmp_path / "in")), str(tmp_path / "c"))
        q.awaitTermination()
    assert [(r.letter_id, r.department, r.subject) for r in store.rows().collect()] == [("a__seg000", "d", "एक")]


def test_http(service):
    import json
    import threading
    import urllib.request

    from letterloom.plans import http

    server = http.serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/departments") as r:
        assert "education" in json.loads(r.read())
    server.shutdown()
    status, _, body = http.answer(service, "GET", "/api/admin/search?q=land+tax&top_k=2", b"")
    assert status == 200 and json.loads(body)[0]["letter_id"] == "tax__seg000"
    assert http.answer(service, "GET", "/api/admin/documents/%25%25", b"")[0] == 400
    assert http.answer(service, "DELETE", "/api/admin/letters/nobody", b"")[0] == 404
    assert http.answer(service, "POST", "/api/generate", b"{}")[0] == 400 and http.answer(service, "GET", "/nowhere", b"")[0] == 404
    status, _, body = http.answer(service, "POST", "/api/export/docx", json.dumps({"draft": "x"}).encode())
    assert status == 200 and body[:2] == b"PK"


def test_upload_reads_one_file(spark, tmp_path):
    s = Service(spark, Settings(str(tmp_path / "in"), str(tmp_path / "s")))
    s.upload("health", "ward", "a [1].txt", "विषय: एक".encode())
    (tmp_path / "in" / "health" / "ward" / "broken.docx").write_bytes(b"not a document")
    found = s.upload("health", "ward", "b.txt", "विषय: दो".encode())
    assert found["letters_found"] == 1 and [r.subject for r in s.store.find().collect()] == ["एक", "दो"]
    assert [r.subject for r in s.document(doc_id_of("health/ward/a [1].txt")).collect()] == ["एक"]


def test_embedding_settings():
    s = Settings.from_env({"EMBEDDING_BACKEND": "http", "EMBEDDING_MODEL": "m", "MODEL_HOST": "http://h:1/", "MODEL_CONTEXT": "512"})
    e = s.embedder()
    assert (type(e).__name__, e.model_name, e.host, e.context) == ("HttpEmbedder", "m", "http://h:1", 512)
    assert Settings.from_env({}).embedder().dimension() == 64
    with pytest.raises(ValueError):
        Settings.from_env({"EMBEDDING_BACKEND": "none"}).embedder()


def test_page():
    from letterloom.plans.http import answer

    assert answer(None, "GET", "/", b"")[:2] == (200, "text/html; charset=utf-8")


def test_settings():
    s = Settings.from_env({"TOP_K": "7", "DOCX_MARGIN_CM": "3"})
    assert s.top_k == 7 and s.layout.margin_cm == 3.0 and s.layout.size_pt == 12


def test_pdf_without_a_reader_is_not_silent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "scan.pdf").write_bytes(b"%PDF")
    s = Service(spark, Settings(str(tmp_path / "in"), str(tmp_path / "s")), pdf=lambda b: [[[("a letter of more than twenty signs", None)]]])
    assert s.reindex()["files_skipped"] == 0 and s.store.rows().count() > 0
    kept, s.pdf = s.store.rows().count(), None
    assert s.reindex(prune=True)["files_skipped"] == 1 and s.store.rows().count() == kept
    with pytest.raises(files.ExtractorUnavailable):
        s.upload("health", "desk", "new.pdf", b"%PDF")
