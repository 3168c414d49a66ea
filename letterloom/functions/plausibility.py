"""How plausible a decoded text is as Hindi: a figure for review, never a gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, is_blank

# The Devanagari block, and what doesn't count as a letter.
DEVANAGARI = r"[ऀ-ॿ]"
NOT_LETTER = rf"(?:{WS}|[\p{{Nd}}.,;:\-/()\[\]])"
# Marks that need a sign before them.
COMBINING = "़ािीुूृॄॅॆेैॉॊोौ्ंःँ"
# Words of official letters.
COMMON_WORDS = [
    "सेवा", "विषय", "दिनांक", "पत्रांक", "कार्यालय", "जिला", "समाहरणालय",
    "आदेश", "अनुरोध", "प्रतिलिपि", "महोदय", "महाशय", "विभाग", "पदाधिकारी",
    "संबंध", "अधिकारी", "प्रेषक", "भवदीय", "विश्वासभाजन", "आवश्यक",
    "कार्यवाही", "प्रबंधक", "अग्रसारित", "अनुसार", "निर्देश", "स्थापना",
]
REVIEW_BELOW = 0.6


def has_devanagari(c: Column | str) -> Column:
    """Whether a sign of the block stands in the text, found in the bytes, where the block is E0 A4 and E0 A5: most texts without one need no regular expression."""
    data = col(c).cast("binary")
    return F.contains(data, F.lit(b"\xe0\xa4")) | F.contains(data, F.lit(b"\xe0\xa5"))


def where_found(c: Column | str, without: Column, value: Column) -> Column:
    return F.when(~has_devanagari(c), without).otherwise(value)


def runs(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(DEVANAGARI + "+"), F.lit(0))


def devanagari_ratio(c: Column | str) -> Column:
    """Devanagari signs per letter-like sign; over 1 where digits of the block stand; 0 without letter-like signs."""
    letters = F.length(F.regexp_replace(col(c), NOT_LETTER, ""))
    own = F.length(col(c)) - F.length(F.regexp_replace(col(c), DEVANAGARI, ""))
    return where_found(c, F.lit(0.0), F.when(letters == 0, F.lit(0.0)).otherwise(own / letters))


def common_word_hits(c: Column | str) -> Column:
    return where_found(c, F.lit(0), F.size(F.filter(runs(c), lambda w: w.isin(COMMON_WORDS))))


def malformed_ratio(c: Column | str) -> Column:
    """Share of Devanagari runs that begin with a combining mark."""
    n = F.size(runs(c))
    begin = F.filter(runs(c), lambda w: F.left(w, F.lit(1)).isin(list(COMBINING)))
    return where_found(c, F.lit(0.0), F.when(n == 0, F.lit(0.0)).otherwise(F.size(begin) / n))


def plausibility(c: Column | str) -> Column:
    ratio = devanagari_ratio(c)
    score = ratio + F.least(0.05 * common_word_hits(c), F.lit(0.3)) - 0.6 * malformed_ratio(c)
    found = F.when(is_blank(c) | (ratio == 0), F.lit(1.0)).otherwise(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))
    return where_found(c, F.lit(1.0), found)


def needs_review(min_plausibility: Column | str) -> Column:
    return col(min_plausibility) < REVIEW_BELOW


def ocr_confidence(words: Column | str) -> Column:
    """Of an array of ``struct<text, conf>``: ``mean`` over words with text and a confidence, 0 without any; ``low`` under 60 or without words."""
    used = F.filter(col(words), lambda w: ~is_blank(w["text"]) & (w["conf"] >= 0))
    mean = F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda s, w: s + w["conf"]) / F.size(used)).otherwise(0.0)
    return F.struct(mean.alias("mean"), ((F.size(used) == 0) | (mean < 60)).alias("low"))


def mean_confidence(words: list[tuple[str, float]]) -> float:
    """The same mean on the driver or in a worker: of words that are not blank and have a confidence; 0 without any."""
    known = [c for text, c in words if text.strip() and c >= 0]
    return sum(known) / len(known) if known else 0.0
