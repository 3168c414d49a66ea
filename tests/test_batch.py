"""Many queries at once against one by one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from letterloom.operators import batch, retrieve
from letterloom.operators.embed import HashEmbedder


@pytest.fixture(scope="module")
def letters(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(50)], k=rnd.randrange(30))) for _ in range(240)]
    texts += texts[:40] * 2  # copies tie
    vectors = HashEmbedder(8).embed(texts)
    rows = [(i, f"k{i}", ["edu", "rev"][i % 3 > 0], t, v if i % 11 else []) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "ord long, letter_id string, department string, text string, embedding array<float>").persist()


def asked(spark, n):
    rnd = random.Random(5)
    texts = ["", "none at all", "w0", "w1 w1 w30"] + [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(1, 5))) for _ in range(n)]
    return [(7 * i, t, v) for i, (t, v) in enumerate(zip(texts[:n], HashEmbedder(8).embed(texts[:n]), strict=True))], "qid long, query string, vector array<double>"


def test_like_one_by_one(spark, letters, monkeypatch):
    rows, kinds = asked(spark, 1000)
    queries = spark.createDataFrame(rows, kinds)
    got = {}
    for r in batch.retrieve_many(letters, queries, 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.letter_id, r.bm25_rank, r.semantic_rank, r.fused_score))
    assert len(got) == 1000 and all(len(v) == 4 for v in got.values())
    one = lambda r, k, where: [(x["rank"], x.letter_id, x.bm25_rank, x.semantic_rank, x.fused_score) for x in retrieve.retrieve(letters, r[1], r[2], k, where).collect()]
    for r in rows[:5] + rows[500:503]:
        assert sorted(got[r[0]]) == one(r, 4, None), r
    monkeypatch.setattr(batch, "SLICE", 3)
    some = batch.retrieve_many(letters, spark.createDataFrame(rows[2:7], kinds), 3, {"department": "edu"}).collect()
    for r in rows[2:7]:
        assert sorted((x["rank"], x.letter_id, x.bm25_rank, x.semantic_rank, x.fused_score) for x in some if x.qid == r[0]) == one(r, 3, {"department": "edu"}), r


def test_nothing_to_find(spark, letters):
    rows, kinds = asked(spark, 3)
    queries = spark.createDataFrame(rows, kinds)
    assert batch.retrieve_many(letters, queries, 3, {"department": "none"}).count() == 0
    assert batch.retrieve_many(letters, queries.limit(0), 3).count() == 0
    assert batch.retrieve_many(letters.limit(2), queries, 3).count() == 6
    with pytest.raises(ValueError):
        batch.retrieve_many(letters, queries, 0)


def test_heaps_and_places_like_sorting():
    rng = np.random.default_rng(1)
    scores, ords = rng.integers(0, 5, (400, 6)).astype(float), rng.permutation(400)
    heap = batch.Heaps(6, 17)
    for i in range(0, 400, 16):
        heap.add(scores[i : i + 16], ords[i : i + 16])
    q, s, o = heap.fold()
    for j in range(6):
        order = np.lexsort((ords, -scores[:, j]))[:17]
        assert o[q == j].tolist() == ords[order].tolist() and s[q == j].tolist() == scores[order, j].tolist()
        marks = (-scores[order, j], ords[order])
        want = [sum((m, n) <= (-x, y) for m, n in zip(*marks, strict=True)) for x, y in zip(scores[:, j], ords, strict=True)]
        assert batch.places(scores[:, j], ords, marks).tolist() == want


def test_memory_of_a_block(spark, letters):
    """A task holds a block for all queries of a slice, however many rows come in a batch and however many terms the queries have."""
    rng, n = np.random.default_rng(2), 20_000
    terms = [f"t{i:05}" for i in range(6000)]
    words = [rng.choice(terms, 8).tolist() for _ in range(600)]
    scorer = batch.Scorer(words, rng.random((600, 8)), dict.fromkeys(terms, 1.5), 10.0, terms)
    lists = lambda x, size: pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(x))
    held = lists(np.sort(rng.integers(0, 6000, (n, 2)), 1).ravel().astype(np.int32), 2)
    rows = pa.record_batch({"n_terms": pa.array(np.full(n, 10, np.int32)), "embedding": lists(rng.random(8 * n).astype(np.float32), 8), "terms": held, "tfs": lists(np.ones(2 * n, np.int32), 2)})
    tracemalloc.start()
    for block in scorer.blocks(iter([rows.slice(0, 3), rows.slice(3)])):
        assert all(scores.shape == (block.num_rows, 600) for _, scores in scorer.score(block))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    before = spark.conf.get(batch.ARROW, None)
    asking, kinds = asked(spark, 3)
    batch.retrieve_many(letters, spark.createDataFrame(asking, kinds), 3).count()
    assert spark.conf.get(batch.ARROW, None) == before
