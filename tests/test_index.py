"""Indexes that follow a store: their results are those of full scans, and they read little."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from letterloom.functions import text
from letterloom.operators import index, retrieve
from letterloom.operators import store as st
from letterloom.operators.embed import HashEmbedder
from tests.test_store import BATCH

WORDS = [f"w{i}" for i in range(60)]


def letters(spark, keys, seed):
    rnd = random.Random(seed)
    rows = []
    for i, k in enumerate(keys):
        n = rnd.randrange(40)
        text = " ".join(rnd.choices(WORDS, [1 / (j + 1) for j in range(60)], k=n))
        rows.append((i, k, text, ["edu", "rev", None][rnd.randrange(3)], None, ["order", None][rnd.randrange(2)], None, "f", False, {}, HashEmbedder(8).embed([text])[0]))
    return spark.createDataFrame(rows, BATCH)


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    s = st.Store(spark, str(tmp_path / "store"), "m", 8)
    s.upsert(letters(spark, [f"k{i:03d}" for i in range(300)], 1))
    return s


def full(store, terms, where):
    rows = store.rows().where(st.matches(where)).withColumnRenamed("document", "text")
    return {r.ord: r.bm25 for r in retrieve.bm25(retrieve.with_tokens(rows), terms).select("ord", "bm25").collect()}


def check_terms(store, terms_index, terms, where=None, k=7):
    want = full(store, terms, where)
    order = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    got, told = terms_index.top(terms, k, where)
    assert [(r.ord, round(r.bm25, 9)) for r in got.collect()] == [(o, round(s, 9)) for o, s in order], (terms, where)
    hits = {r.ord: r.bm25 for r in terms_index.scores(terms, where).collect()}
    assert all(abs(hits.get(o, 0.0) - s) < 1e-9 for o, s in want.items()) and set(hits) <= set(want)
    return told


def test_terms_follow_the_store(spark, store, tmp_path):
    terms = index.TermIndex(store, str(tmp_path / "terms"))
    told = check_terms(store, terms, ["w50", "w41", "w50", "none"])
    assert 0 < told["read"] <= told["blocks"]
    skipped = check_terms(store, terms, ["w0", "w55"], k=3)
    assert skipped["read"] < skipped["blocks"]
    check_terms(store, terms, ["w0"], {"department": "edu"})  # in over half of the candidates: the floor
    check_terms(store, terms, ["w30", "w2"], {"department": "rev", "letter_type": "order"})
    check_terms(store, terms, ["none"], k=4)
    store.upsert(letters(spark, [f"k{i:03d}" for i in range(40, 60)] + ["new1", "new2"], 2))
    store.delete_ids(["k001", "k045"])
    check_terms(store, terms, ["w50", "w41", "w3"])
    check_terms(store, terms, ["w0", "w9"], {"letter_type": "order"})
    head = terms.head()
    assert len(head["segments"]) == 2 and spark.read.parquet(f"{terms.root}/s{head['number']}/docs").count() == 21  # what changed, and no more
    # Only the terms' blocks are asked for.
    plan = terms._blocks(head, {"w3": 1.0}, None)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w3)]" in plan or "In(term, [w3])" in plan
    store.prune(1)
    for i in range(index.CHAIN):
        store.upsert(letters(spark, [f"k{i:03d}"], 10 + i))
        terms.update()
    assert len(terms.head()["segments"]) <= index.CHAIN
    terms.prune()
    check_terms(store, terms, ["w7", "w1"])


def check_balls(store, balls, vector, k, where=None):
    want = [(r.letter_id, round(r.distance, 9)) for r in store.query(vector, k, where).collect()]
    got, told = balls.query(vector, k, where)
    assert [(r.letter_id, round(r.distance, 9)) for r in got.collect()] == want
    return told


def test_balls_follow_the_store(spark, store, tmp_path):
    balls = index.BallIndex(store, str(tmp_path / "balls"))
    vectors = HashEmbedder(8).embed(["w50 w41", "w0 w1 w2 w3", "w7"])
    told = [check_balls(store, balls, v, 3) for v in vectors]
    assert min(t["measured"] for t in told) < 300 and all(t["vectors"] == 300 for t in told)
    check_balls(store, balls, vectors[0], 400)
    check_balls(store, balls, [0.0] * 8, 5)
    check_balls(store, balls, vectors[1], 5, {"department": "edu"})
    store.upsert(letters(spark, [f"k{i:03d}" for i in range(40, 60)] + ["new1"], 3))
    store.delete_where({"department": "rev"})
    for v in vectors:
        check_balls(store, balls, v, 10)
    assert len(balls.head()["segments"]) == 2
    store.keep_ids(store.rows().select("letter_id").limit(0))
    assert balls.query(vectors[0], 3)[0].count() == 0
    with pytest.raises(ValueError):
        balls.query(vectors[0], 0)


def test_balls_skip_most_of_what_lies_apart(spark, tmp_path):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, f"k{i}", "t", "edu", None, None, None, "f", False, {}, [x + rnd.gauss(0, 0.02) for x in centres[i % 20]]) for i in range(2000)]
    s = st.Store(spark, str(tmp_path / "store"), "m", 8)
    s.upsert(spark.createDataFrame(rows, BATCH))
    balls = index.BallIndex(s, str(tmp_path / "balls"))
    told = check_balls(s, balls, centres[4], 10)
    assert told["measured"] < 0.2 * told["vectors"]
    assert s.rows().select(F.count("*")).first()[0] == 2000


def test_a_letter_counts_its_own_words(spark):
    rnd = random.Random(5)
    texts = [None, "", "a", "b a b a b", *(" ".join(rnd.choices(WORDS, k=rnd.randrange(80))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.term_counts(text.tokenize("t")).alias("n"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = None if texts[r.i] is None else sorted(Counter(texts[r.i].split()).items())
        assert (r.n if r.n is None else [tuple(x) for x in r.n]) == want


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_blocks_do_not_depend_on_batches(cut):
    rnd = random.Random(cut)
    rows = sorted(((rnd.choice("abc"), rnd.choice([None, "x", "y"]), rnd.choice([None, "z"]), i, rnd.randrange(1, 9), rnd.randrange(9, 99)) for i in range(500)), key=lambda r: [str(x) for x in r[:3]])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + cut], strict=True), [pa.string()] * 3 + [pa.int64()] + [pa.int32()] * 2, strict=True)], names=list("abcdef")) for i in range(0, 500, cut)]
    want = []
    for r in rows:
        if not want or want[-1][0] != r[:3] or len(want[-1][1]) == 8:
            want.append((r[:3], []))
        want[-1][1].append(r[3:])
    got = [x for b in index.blocks(8)(iter(batches)) for x in b.to_pylist()]
    assert [((x["term"], x["department"], x["letter_type"]), list(zip(x["ords"], x["tfs"], x["sizes"], strict=True)), x["tf"], x["n_terms"]) for x in got] == [(k, own, max(o[1] for o in own), min(o[2] for o in own)) for k, own in want]
