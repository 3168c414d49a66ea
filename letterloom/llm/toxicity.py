"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding disguises.

Method. Texts are lower-cased; homoglyphs and digits fold to the Latin letters they stand for, and so do a few signs between
letters; everything else that is not a letter ends a word. The lexicon has whole words and beginnings of other words, with their log
odds between toxic and other documents as weights. It is learnt in rounds: each looks at the toxic documents without an entry so far, so that what tells
few of them apart (the words of a rare language) isn't drowned by the rest. One Aho-Corasick automaton finds all of them; a word counts once, by its heaviest
entry, and not at all inside an exception phrase (two words, one of them in the lexicon, seen mostly in documents that are not toxic). The sum
over ``words + SMOOTH`` is the density x, and ``x / (x + t)`` the score; t is the cut with the fewest errors on the sample.

Bounds: the lexicon is fitted on at most ``SAMPLE`` labelled documents (smallest hashes of their ids) and keeps every entry and
exception that passes the test of evidence, of any length; the sample bounds their number, and a lexicon over ``ENTRIES`` is logged. Scoring reads each whole text once, in its scan task.

Rows: every input row gives one row; null and empty texts score 0; if a ``doc_id`` has several labels the largest counts; null labels
and ids don't teach; with no toxic label to learn from everything scores 0. Other columns are ignored, or carried where rows are filtered.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spread import spread
from . import _packs as P
from ._session import checkpoints

LOG = logging.getLogger(__name__)
SAMPLE = 20_000
#: A usual lexicon is no larger; nothing is cut there.
ENTRIES = 512
HELD = 16 << 20  # letters of features that a task sums before it sends them
SMOOTH = 20
STEMS = (4, 5, 6)
#: A round that finds nothing ends the search; this many are never needed by the sample's size.
ROUNDS = 8
#: Least evidence for an entry: a chance below one in ten million, as hundreds of thousands of words are tried.
EVIDENCE = 30.0

# Letters and digits that are used in place of Latin letters (Cyrillic, Greek, digits).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}
# Signs that stand for a letter between two letters.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class Folding(dict):
    """A translation table that fills itself: one letter in, one lower-case Latin lookalike, the letter itself or a space out."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        elif 0xFF01 <= code <= 0xFF5E:  # full width
            out = self[code - 0xFEE0]
        else:
            low = c.lower()
            out = LOOKALIKES.get(low) or (low if c.isalpha() else " ")
        self[code] = out
        return out


FOLDING = Folding()
BETWEEN = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")


def fold(text: str) -> str:
    if any(s in text for s in SIGNS):
        text = BETWEEN.sub(lambda m: "".join(SIGNS[c] for c in m[0]) if len(m[0]) == 1 else m[0], text)
    return text.translate(FOLDING)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # "word" or "begin*"
    exceptions: frozenset[tuple[str, str]] = frozenset()
    cut: float = 1.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def automaton(self):
        if "machine" not in self.__dict__:
            machine = ahocorasick.Automaton()
            for w, x in self.weights.items():
                machine.add_word(f" {w[:-1]}" if w.endswith("*") else f" {w} ", (len(w), x, w))
            if self.weights:
                machine.make_automaton()
            self.__dict__["machine"] = machine
        return self.__dict__["machine"]

    def hits(self, text: str | None) -> tuple[dict[int, tuple[float, str]], str]:
        """The heaviest entry for each word that has one, by the place of the blank before it; and the folded text."""
        folded = f" {' '.join(fold(text or '').split())} "
        found: dict[int, tuple[float, str]] = {}
        if self.weights:
            for end, (n, x, w) in self.automaton().iter(folded):
                start = end - (n - 1 if w.endswith("*") else n + 1)
                if (x, w) > found.get(start, (0.0, "")):
                    found[start] = (x, w)
        return found, folded

    def density(self, text: str | None) -> float:
        found, folded = self.hits(text)
        if not found:
            return 0.0
        total = sum(x for at, (x, _) in found.items() if not (self.exceptions and any(p in self.exceptions for p in pairs(folded, at))))
        return 100.0 * total / (folded.count(" ") - 1 + SMOOTH)

    def score(self, text: str | None) -> float:
        x = self.density(text)
        return x / (x + self.cut)


def pairs(folded: str, at: int) -> list[tuple[str, str]]:
    """The word that begins after ``at`` with the word before it and with the word after it."""
    end = folded.index(" ", at + 1)
    word, out = folded[at + 1 : end], []
    if at:
        out.append((folded[folded.rindex(" ", 0, at) + 1 : at], word))
    if end + 1 < len(folded):
        out.append((word, folded[end + 1 : folded.index(" ", end + 1)]))
    return out


def counted(sample: DataFrame, features, explained=None) -> tuple[DataFrame, int, int]:
    """``f, pos, neg``: sampled documents of either label with each of ``features(text)``, summed in the task before the shuffle; and how many documents of
    either label there are. Toxic documents that are ``explained(text)`` are left out."""

    def run(batches):
        total: dict[str, list[int]] = {}
        size = 0
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y and explained and explained(text):
                    continue
                for f in (*features(text), ""):  # the empty one counts documents
                    if f not in total:
                        total[f], size = [0, 0], size + len(f)
                    total[f][1 - y] += 1
            if len(total) > 200_000 or size > HELD:
                yield rows(total)
                total, size = {}, 0
        yield rows(total)

    def rows(total):
        return pa.record_batch({"f": pa.array(list(total), pa.string()), "pos": pa.array([x for x, _ in total.values()], pa.int64()), "neg": pa.array([x for _, x in total.values()], pa.int64())})

    table = sample.select("text", "toxic").mapInArrow(run, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).checkpoint()
    every = table.where("f = ''").first()
    return table.where("f <> ''"), every.pos if every else 0, every.neg if every else 0


def words_of(text: str | None) -> set[str]:
    return set(fold(text or "").split())


def shingle_hash(seed: int):
    return lambda i: F.xxhash64(F.lit(seed), F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))


def fit(docs: DataFrame, labels: DataFrame, teaches: Column) -> Model:
    """``teaches`` tells, from ``doc_id``, which labelled rows may be learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(teaches)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    checkpoints(docs.sparkSession)
    P.arrow_limits(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Copies, near ones too, would make a document's own words look like evidence: of those that share one of four least shingles one stays.
    words = F.split(F.lower("text"), r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0)))
    keys = docs.join(F.broadcast(known), "doc_id").withColumn("w", words)  # at most SAMPLE rows of 12 bytes are broadcast
    keys = keys.select("doc_id", "toxic", *[F.array_min(F.transform(starts, shingle_hash(seed))).alias(f"k{seed}") for seed in range(4)])
    for seed in range(4):  # at most SAMPLE rows; which one stays does not depend on how they are dealt out
        w = Window.partitionBy(f"k{seed}").orderBy(F.xxhash64("doc_id"), "doc_id", *[f"k{i}" for i in range(4)])
        keys = keys.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    keys = keys.select("doc_id", "toxic").distinct().checkpoint()
    sample = docs.join(F.broadcast(keys), "doc_id").checkpoint()
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()

    def telling(table: DataFrame, toxic: int, other: int) -> dict[str, float]:
        """The entries with evidence, and their weights."""
        if not toxic or not other:
            return {}
        weight = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (other + 1))
        both, share = F.col("pos") + F.col("neg"), toxic / (toxic + other)
        # Twice the log-likelihood ratio against independence; the term of the other side is left out where it is empty.
        gain = 2 * (F.col("pos") * F.log(F.col("pos") / (both * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0))
        kept = table.where("pos >= 3 AND pos >= 4 * neg").withColumn("w", weight).where((F.col("w") >= 2.5) & (gain >= EVIDENCE))
        return {r.f: r.w for r in kept.orderBy(F.desc(F.col("pos") * F.col("w")), "f").collect()}

    model = Model()

    def rounds(features) -> None:
        for _ in range(ROUNDS):
            held = Model(dict(model.weights))
            found = telling(*counted(sample, features(frozenset(held.weights)), lambda text: bool(held.hits(text)[0])))
            if not found:
                break
            model.weights = found | model.weights

    rounds(lambda known: lambda text: words_of(text) - known)
    # Of words that are not entries themselves: a beginning must tell something that no entry tells.
    rounds(lambda known: lambda text: {f"{w[:n]}*" for w in words_of(text) - known for n in STEMS if len(w) > n} - known)
    words = sum(not w.endswith("*") for w in model.weights)

    def phrases(text):
        found, folded = model.hits(text)
        return {" ".join(p) for at in found for p in pairs(folded, at)}

    odd = counted(sample, phrases)[0].where((F.col("neg") >= 3) & (F.col("neg") * n[1] > F.col("pos") * n[0])).orderBy(F.desc("neg"), "f").collect()
    model.exceptions = frozenset(tuple(r.f.split(" ")) for r in odd)
    (LOG.warning if len(model.weights) > ENTRIES else LOG.info)("lexicon: %d words, %d beginnings, %d exceptions", words, len(model.weights) - words, len(odd))

    def densities(batches):
        for batch in batches:
            yield pa.record_batch({"x": pa.array([model.density(t) for t in batch.column(0).to_pylist()], pa.float64()), "y": batch.column(1)})

    rows = sample.select("text", "toxic").mapInArrow(densities, "x double, y int").collect()  # at most SAMPLE pairs of numbers
    model.cut = best_cut(np.array([r.x for r in rows]), np.array([r.y for r in rows]))
    return model


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The density from which calling a document toxic makes the fewest errors: midway between its neighbours there."""
    value = np.unique(np.r_[0.0, x])
    if len(value) < 2:
        return 1.0
    toxic, other = np.sort(x[y == 1]), np.sort(x[y == 0])
    missed, wrong = np.searchsorted(toxic, value[1:]), len(other) - np.searchsorted(other, value[1:])
    i = int((missed + wrong).argmin())
    return float((value[i] + value[i + 1]) / 2)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``"""
    P.arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``cut``."""
    P.arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < cut for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold_of(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold_of(5) != 0)
    return toxicity(docs, model).select("doc_id", F.coalesce(fold_of(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
