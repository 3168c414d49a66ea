"""Language identification by rank-order profiles of character n-grams.

Method. A text is lower-cased; runs of other signs than letters become one word boundary. Its n-grams of one to three signs are ranked by
frequency (ties: by code). A language's profile is the ranking of the ``PROFILE`` most frequent n-grams of its training texts. The out-of-place
distance sums, over the document's ``PROFILE`` most frequent n-grams, how far each one's rank is from its rank in the profile, or
``PROFILE`` if it is not there. The nearest profile wins (ties: the smaller name); the score is 1 less the mean distance over ``PROFILE``.

Bounds: a language is fitted on about ``SAMPLE`` documents or fewer (those whose id's hash is below the fraction that gives so many). Every value of
``lang`` is learnt, ``BLOCK`` of them by one job; the driver and each task hold at most ``PROFILE`` n-grams a language, and ranks in a table for each
block, so that memory grows with the number of languages and not with its square. Prediction reads each whole text once, in its scan task.

Rows: every input row gives one row; null texts and texts without a letter are ``und`` with score 0; if nothing could be learnt all are;
other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spread import spread
from . import _packs as P

PROFILE = 300
SAMPLE = 4_000
BLOCK = 64  # languages whose profiles are one table


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's distinct n-grams, 21 bits a sign and 0 for a boundary, and how often each occurs."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(letters()[code], code, 0)
    code = np.r_[0, code, 0]
    code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = code[:-1] << 21 | code[1:]
    three = (two[:-1] << 21 | code[2:])[code[1:-1] != 0]
    return np.unique(np.concatenate([code[code != 0], two, three]), return_counts=True)


@dataclass
class Block:
    """The profiles of some languages."""

    names: list[str]  # sorted
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # (grams, names); PROFILE where it has none

    def nearest(self, gram: np.ndarray) -> tuple[int, str]:
        """Distance and name; of equal distances the smaller name."""
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        there = self.ranks[at].astype(np.int64)
        there[self.grams[at] != gram] = PROFILE
        out = np.where(there == PROFILE, PROFILE, np.abs(there - np.arange(len(gram))[:, None])).sum(0)
        best = int(out.argmin())
        return int(out[best]), self.names[best]


@dataclass
class Profiles:
    blocks: list[Block]

    def predict(self, text: str | None) -> tuple[str, float]:
        gram, count = ngrams(text)
        if not len(gram) or not self.blocks:
            return "und", 0.0
        if len(gram) > 2 * PROFILE:  # the sort below only needs what can be among the first
            least = np.partition(count, len(count) - PROFILE)[len(count) - PROFILE]
            gram, count = gram[count >= least], count[count >= least]
        gram = gram[np.lexsort((gram, -count))[:PROFILE]]
        far, name = min(block.nearest(gram) for block in self.blocks)
        return name, 1.0 - far / (PROFILE * len(gram))


def fit(docs: DataFrame, teaches: Column) -> Profiles:
    """``docs`` has ``doc_id, text, lang``; ``teaches`` tells, from ``doc_id``, which rows may be learnt from."""
    P.arrow_limits(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").where(teaches)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row a language
    return Profiles([b for i in range(0, len(sizes), BLOCK) for b in learnt(known, sizes[i : i + BLOCK])])


def learnt(known: DataFrame, sizes: list) -> list[Block]:
    """The block of the languages in ``sizes``, rows of ``lang`` and its number of documents; none if no text of theirs holds a letter."""
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, SAMPLE / r.n)])
    sample = known.where(F.col("lang").isin([r.lang for r in sizes])).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lang, []).append(ngrams(text))
            for lang, parts in total.items():
                total[lang] = [added(parts)]
        for lang, [(gram, n)] in total.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram), "n": pa.array(n)})

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    rows = counts.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < PROFILE).collect()  # PROFILE rows a language
    if not rows:
        return []
    names, grams = sorted({r.lang for r in rows}), np.unique(np.array([r.gram for r in rows], np.int64))
    ranks, column = np.full((len(grams), len(names)), PROFILE, np.int16), {x: i for i, x in enumerate(names)}
    for r in rows:
        ranks[np.searchsorted(grams, r.gram), column[r.lang]] = r.rank
    return [Block(names, grams, ranks)]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score``"""
    P.arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    return identify(docs, fit(docs, fold != 2)).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
