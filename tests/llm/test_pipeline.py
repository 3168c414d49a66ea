"""The pipeline's stages against brute force, and against what they must keep."""

import hashlib
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from letterloom.llm import bpe, toxicity
from tests.llm.test_operators import brute_contamination, brute_jaccard, brute_lines
from tests.test_queries import SF


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.fold_of(5) != 0)
    kept = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if model.score(r.text) < 0.5]
    ids = [i for i, _ in kept]
    kept = [(i, t) for i, (_, _, t) in zip(ids, brute_lines([t for _, t in kept], ids), strict=True)]
    classes, _ = brute_jaccard([t for _, t in kept])
    kept = [x for n, (x, (_, top)) in enumerate(zip(kept, classes, strict=True)) if n == top]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [x for x, (_, hit, _) in zip(kept, brute_contamination([t for _, t in kept], items), strict=True) if not hit]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [i for i, _ in kept] and len(got) > docs.count() / 2
    for i, t in kept:
        coded = struct.pack(f"<{len(encode(t))}I", *encode(t))
        assert bytes(got[i].token_ids) == coded and got[i].ids_sha256 == hashlib.sha256(coded).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f", None, None, None), (2, "a b c d e f", None, None, None), (3, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    left = sorted(map(str, [(r.doc_id, r.text) for r in out.collect()]))
    assert left == sorted(map(str, [(None, None), (1, ""), (2, "a b c d e f")]))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    same, other = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    schema = "doc_id long, text string"
    near = spark.createDataFrame([(1, same), (5, same), (5, other), (6, f"{same} x")], schema)
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, near, SF).collect())) == [(1, same), (5, other)]
    alone = spark.createDataFrame([(None, same, 1, "p"), (None, f"{same} x", 2, "q"), (None, other, 3, "r"), (4, other, 4, "s"), (4, other, 5, "t"), (None, None, 6, "u"), (None, "", 7, "v")], f"{schema}, row_key int, ROW_KEY_ string")
    kept = sorted(corpus_pipeline.near_duplicates(spark, alone.repartition(3), SF).collect(), key=lambda r: r.row_key)
    assert kept[0].row_key in (1, 2) and kept[1].row_key in (4, 5) and [tuple(r) for r in kept[2:]] == [(None, None, 6, "u"), (None, "", 7, "v")]
    assert all(r.text == ({1: same, 2: f"{same} x"} | dict.fromkeys((4, 5), other))[r.row_key] for r in kept[:2])
    assert sorted(r.row_key for r in corpus_pipeline.contaminated(spark, alone, SF).collect()) == [*range(1, 8)]
    hit = spark.createDataFrame([(None, item), (7, f"so {item}"), (7, other), (None, other), (8, None)], schema)
    left = corpus_pipeline.contaminated(spark, hit, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("7", other), ("8", "None"), ("None", other)]


def test_no_table_that_grows_is_broadcast(spark):
    """What is broadcast passes whole through the driver. Only the (bounded) list of large units may."""
    ran = lambda: {x.executionId(): x.physicalPlanDescription() for x in map(held.apply, range(held.size()))}
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{text} {'x ' * (i % 4)}") for i in range(12)] + [(20, "another text"), (21, None)], "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    held = store.executionsList()
    before = set(ran())
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).orderBy("doc_id").collect()] == [0, 20, 21]
    held = store.executionsList()
    plans = [p.split("+- == Initial Plan ==")[0] for k, p in ran().items() if k not in before]
    assert plans and sum("BroadcastHashJoin" in p for p in plans) <= 1 and not any("LeftSemi" in p and "BroadcastHashJoin" in p for p in plans)
