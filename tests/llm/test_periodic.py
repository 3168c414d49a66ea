"""Runs against brute force over all periods, and in SQL."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from letterloom.llm import periodic


def brute(words, least=6, exponent=4):
    """Maximal stretches for every period from the smallest; what a smaller one explains is left out."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and not any(p < q and s <= i and s + m >= j + q for s, m, p in out):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_words(rnd):
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 4 + ["a"], ["a", "b"] * 3 + ["a"], list("abaab" * 6), list("aabaabaab" * 5 + "x" + "ab" * 9), list("x" * 30 + "y" * 30)]
    for _ in range(120):
        out.append([rnd.choice("ab" if rnd.random() < 0.5 else "abcd") for _ in range(rnd.randrange(60))])
    for _ in range(60):
        root = [rnd.choice("abc") for _ in range(rnd.randrange(1, 12))]
        out.append([*rnd.choices("abc", k=rnd.randrange(9)), *(root * 9)[: rnd.randrange(9 * len(root))], *rnd.choices("abc", k=rnd.randrange(9)), *(root * 6)])
    return out


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (1, 2), (10, 3)])
def test_runs_like_brute_force(least, exponent):
    rnd = random.Random(5)
    docs = odd_words(rnd)
    coded = [np.array([ord(c) for c in d], np.int64) - 97 for d in docs]
    for got, words in zip(periodic.runs_of(coded, least, exponent), docs, strict=True):
        assert list(map(tuple, got.tolist())) == brute(words, least, exponent), words
    assert [len(r) for r in periodic.runs_of([np.zeros(0, np.int64)] * 2, 6, 4)] == [0, 0]


def test_parts_like_brute_force():
    rng = np.random.default_rng(2)
    x, _ = periodic.closed([rng.integers(0, 2, 50), rng.integers(0, 3, 40), np.zeros(30, np.int64)])
    rank, common = periodic.suffixes(x)
    every = sorted(range(len(x)), key=lambda i: x[i:].tolist())
    assert [every.index(i) for i in range(len(x))] == rank.tolist()
    shared = lambda i, j: next(k for k in range(len(x)) if x[i + k] != x[j + k])
    assert common[1:].tolist() == [shared(i, j) for i, j in zip(every[:-1], every[1:], strict=True)]
    i, j = rng.integers(0, len(x), (2, 500))
    i, j = i[i != j], j[i != j]
    assert periodic.Matches(x).common_prefix(i, j).tolist() == [shared(a, b) for a, b in zip(i, j, strict=True)]
    nexts = periodic.next_beyond(rank, periodic.table_of(rank), np.less)
    assert nexts.tolist() == [next((k for k in range(i + 1, len(x)) if rank[k] < rank[i]), len(x)) for i in range(len(x))]


def test_odd_rows(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    texts = [None, "", " \t\n", "one", *(rnd.choice([" ", "\n", "  \t"]).join(d) for d in odd_words(rnd)), "ünï x ünï x " * 8, "a " * 30_000, " ".join(f"w{i % 7001}" for i in range(40_000))]
    ids = [*range(len(texts) - 3), None, -5, 5]
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)] * 2
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string, kept string, n_runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _, _ in rows:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", t or ""), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words) if len(words) < 30_000 else [(0, len(words), len(set(words)))] if i is None or h % 10 else None
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None) if runs is not None else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs))))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, periodic.op12_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
