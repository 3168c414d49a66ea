"""The Jaccard join where packs send many short rows, and its word hashes."""

import functools
import random

import numpy as np
import xxhash

from letterloom.llm import _packs, _prints, jaccard_join
from tests.llm.test_operators import brute_jaccard


def test_short_words_are_hashed_as_arrays(monkeypatch):
    rnd = random.Random(2)
    signs = [*range(9), *range(14, 32), *range(33, 256)]
    words = [bytes(rnd.choices(signs, k=n)) for n in range(1, 17) for _ in range(30)]
    text, keys = b" ".join(words), [0, 1, (1 << 64) - 1, *[rnd.getrandbits(64) for _ in range(9)]]
    want = [[xxhash.xxh3_64_intdigest(w, key) for w in words] for key in keys]
    long = b" ".join([b"x" * 17, b"yz", b"q" * 300])
    assert _prints.word_prints(long, np.array([0, len(long)]), 7).tolist() == [xxhash.xxh3_64_intdigest(w, 7) for w in long.split()]
    assert _prints.word_prints(b"ab", np.array([0, 1, 1, 2]), 7).tolist() == [xxhash.xxh3_64_intdigest(w, 7) for w in (b"a", b"b")]
    assert _prints.word_prints(b"", np.array([0, 0]), 7).tolist() == [] == _prints.word_prints(b" \n", np.array([0, 2]), 7).tolist()

    def one_by_one(*_):
        raise AssertionError("a call for each word")

    monkeypatch.setattr(xxhash, "xxh3_64_digest", one_by_one)
    assert [_prints.word_prints(text, np.array([0, len(text)]), key).tolist() for key in keys] == want


def test_many_packs_and_buckets(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 60))) for _ in range(60)]
    texts += [f"{t} end" for t in texts[:30]] + texts[20:40] + [f"{t} z" for t in texts[60:70]] + [None, "", " "]
    monkeypatch.setattr(_packs, "BUCKET_BYTES", 900)
    monkeypatch.setattr(_packs, "packed", functools.partial(_packs.packed, target=700))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want, _ = brute_jaccard(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
