"""Reindexing what has changed only, vectors by content, and changes that are cut off half way."""

import json
import os
import shutil

import pytest

from letterloom.operators.embed import HashEmbedder
from letterloom.plans import service as sv
from letterloom.plans.service import Service, Settings, doc_id_of


class Counting:
    """A model that notes what it is asked, where every process can see it."""

    model_name = "counting"

    def __init__(self, log):
        self.log = str(log)

    def embed(self, texts):
        with open(self.log, "a", encoding="utf-8") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return HashEmbedder(8).embed(texts)

    def dimension(self):
        return 8

    def asked(self):
        with open(self.log, encoding="utf-8") as f:
            return [json.loads(x) for x in f]


def put(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text, encoding="utf-8")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for i in range(6):
        put(root, f"edu/desk/f{i}.txt", f"letter number {i}")
    put(root, "rev/desk/same.txt", "one text")
    put(root, "rev/other/twin.txt", "one text")
    put(root, "rev/none.txt", "")
    return root


def opened(spark, root, tmp_path):
    return Service(spark, Settings(str(root), str(tmp_path / "s")), Counting(tmp_path / "log"))


def texts(s):
    return {r.letter_id: r.document for r in s.store.rows().collect()}


def test_only_what_changed_is_read(spark, tree, tmp_path, monkeypatch):
    s = opened(spark, tree, tmp_path)
    first = s.reindex()
    assert (first["letters_found"], first["letters_indexed"], first["added"], first["same"]) == (9, 9, 9, 0)
    asked = s.embedder.asked()
    assert len(asked) == len(set(asked)) == 8  # equal texts meet the model once
    read, ingest = [], sv.ingest
    monkeypatch.setattr(sv, "ingest", lambda *a, only=None, **k: read.append(only) or ingest(*a, only=only, **k))
    version = s.store.version()
    assert s.reindex(prune=True) == first | {"added": 0, "same": 9}
    assert not read and s.store.version() == version and s.embedder.asked() == asked  # nothing was read, embedded or written
    os.utime(tree / "edu/desk/f1.txt", (1, 1))  # another time, the same content
    assert s.reindex()["same"] == 9 and not read
    put(tree, "edu/desk/f2.txt", "letter number 3")  # a text that is known
    put(tree, "new/desk/g.txt", "a new letter")
    (tree / "rev/desk/same.txt").unlink()
    told = s.reindex()
    assert (told["added"], told["changed"], told["gone"], told["same"]) == (1, 1, 1, 7) and told["letters_found"] == 9
    assert read == [["edu/desk/f2.txt", "new/desk/g.txt"]] and s.embedder.asked() == [*asked, "a new letter"]
    assert texts(s)["f2__seg000"] == "letter number 3" and "same__seg000" in texts(s)  # what is gone stays until pruned
    s.reindex(prune=True)
    assert "same__seg000" not in texts(s) and len(texts(s)) == 9 and len(read) == 1
    s.delete_letter("g__seg000")
    assert s.reindex()["again"] == 1 and texts(s)["g__seg000"] == "a new letter"
    again = opened(spark, tree, tmp_path)
    assert again.reindex(full=True)["letters_found"] == 9 and again.embedder.asked() == [*asked, "a new letter"]


def test_shared_stems_and_overrides(spark, tree, tmp_path):
    s = opened(spark, tree, tmp_path)
    put(tree, "a/b/x.y.txt", "from a")
    put(tree, "c/d/x.y.txt", "from c")
    found = s.reindex()
    assert (found["letters_found"], found["letters_indexed"]) == (11, 10) and texts(s)["x.y__seg000"] == "from c"
    put(tree, "a/b/x.y.txt", "from a again")
    assert s.reindex()["again"] == 1 and texts(s)["x.y__seg000"] == "from c"  # the later file still wins
    (tree / "c/d/x.y.txt").unlink()
    s.reindex(prune=True)
    assert texts(s)["x.y__seg000"] == "from a again"
    put(tree, ".meta/x.y__seg000.meta.json", json.dumps({"department": "by hand"}))
    assert s.reindex()["again"] == 1 and s.store.get(["x.y__seg000"]).first().department == "by hand"
    (tree / ".meta/x.y__seg000.meta.json").unlink()
    s.reindex()
    assert s.store.get(["x.y__seg000"]).first().department == "a"


def test_like_a_full_index(spark, tree, tmp_path):
    s = opened(spark, tree, tmp_path)
    s.reindex()
    put(tree, "edu/desk/f0.txt", "other")
    shutil.rmtree(tree / "rev")
    s.reindex(prune=True)
    whole = Service(spark, Settings(str(tree), str(tmp_path / "t")), Counting(tmp_path / "log2"))
    whole.reindex()
    rows = lambda x: sorted((r.letter_id, r.document, r.department, r.source_file, tuple(r.embedding)) for r in x.store.rows().collect())
    assert rows(s) == rows(whole)


def test_cut_off_half_way(spark, tree, tmp_path, monkeypatch):
    s = opened(spark, tree, tmp_path)
    s.reindex()

    class Died(Exception):
        pass

    def dies(*_, **__):
        raise Died

    with monkeypatch.context() as m:  # after the file, before the store
        m.setattr(sv.Store, "upsert", dies)
        with pytest.raises(Died):
            s.upload("edu", "desk", "up.txt", b"uploaded")
        with pytest.raises(Died):
            s.patch_metadata("f1__seg000", department="patched")
    with monkeypatch.context() as m:  # before the file
        m.setattr(sv, "whole", lambda path, content: dies() if path.suffix == ".txt" else path.write_bytes(content))
        with pytest.raises(Died):
            s.upload("edu", "desk", "never.txt", b"never")
    with monkeypatch.context() as m:  # after the store, before the file
        m.setattr(sv.Path, "unlink", dies)
        with pytest.raises(Died):
            s.delete_document(doc_id_of("edu/desk/f3.txt"))
    assert "up__seg000" not in texts(s) and (tree / "edu/desk/f3.txt").exists()
    again = opened(spark, tree, tmp_path)
    assert texts(again)["up__seg000"] == "uploaded" and again.store.get(["f1__seg000"]).first().department == "patched"
    assert "never__seg000" not in texts(again) and not (tree / "edu/desk/never.txt").exists()
    assert "f3__seg000" not in texts(again) and not (tree / "edu/desk/f3.txt").exists()
    assert not list(again.intents.iterdir())


def test_search_by_the_index(spark, tree, tmp_path):
    s = opened(spark, tree, tmp_path)
    s.reindex()
    from letterloom.operators.retrieve import retrieve

    for query in ("letter 3", "one text", "nothing"):
        [v] = s.embedder.embed([query])
        want = [(r.letter_id, r.bm25_rank, r.semantic_rank) for r in retrieve(s._rows(), query, v, 4).collect()]
        assert [(r.letter_id, r.bm25_rank, r.semantic_rank) for r in s.search(query, 4).collect()] == want
    s.upload("edu", "desk", "z.txt", b"letter letter 3")
    assert s.search("letter 3", 1).first().letter_id in ("z__seg000", "f3__seg000")
    assert len(s.terms.head()["segments"]) == 2
