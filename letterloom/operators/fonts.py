"""Text typed in legacy 8-bit Hindi fonts: font classes, run grouping and an ordered-rewrite decoder driven by a table."""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plausibility import plausibility
from ..functions.text import col, is_blank, ws_strip

# Font names that mean a legacy encoding, and those that never do (which win).
LEGACY = ["kruti dev", "devlys", "chanakya", "shusha", "walkman", "shivaji", "krishna", "amar ujala", "dv-"]
PASSTHROUGH = [
    "mangal", "nirmala", "times new roman", "calibri", "cambria", "arial", "tahoma", "segoe", "consolas", "verdana", "aparajita", "utsaah", "kokila",
]


def is_legacy_font(font: Column | str) -> Column:
    name = F.lower(ws_strip(col(font)))

    def any_of(prefixes: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in prefixes:
            found = found | name.startswith(p)
        return found

    return F.coalesce(any_of(LEGACY) & ~any_of(PASSTHROUGH), F.lit(False))


def islands(rows: DataFrame, keys: Sequence[str], order: str, value: str, number: str = "group_no") -> DataFrame:
    """``rows`` with the number, from 0, of the stretch of equal values that each belongs to, in one window on the keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_changed", changed).withColumn(number, (F.sum("_changed").over(w) - 1).cast("int")).drop("_changed")


def group_runs(runs: DataFrame, keys: Sequence[str] = ("source_file", "line_no"), order: str = "run_no", font: str = "font_name", text: str = "text") -> DataFrame:
    """Merge consecutive runs of one font class: ``keys, group_no, legacy, font_name, text``.

    Empty runs don't count; a group's font is the first that is not null.
    """
    island = islands(runs.where(F.length(text) > 0).withColumn("legacy", is_legacy_font(font)), keys, order, "legacy")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(font).alias("f"), F.col(text).alias("t"))))
    grouped = island.groupBy(*keys, "group_no", "legacy").agg(parts.alias("p"))
    first = F.get(F.filter(F.col("p"), lambda x: x["f"].isNotNull()), F.lit(0))["f"]
    return grouped.select(*keys, "group_no", "legacy", first.alias("font_name"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


# The chart below says which key prints which sign, by kind, as the keyboard of the font family shows it. It is data: a table for another font is read
# from a file with :func:`read_mapping`.
# Key, sign.
VOWELS = [("v", "अ"), ("vk", "आ"), ("b", "इ"), ("bZ", "ई"), ("Ã", "ई"), ("m", "उ"), ("Å", "ऊ"), ("_", "ऋ"), (",", "ए"), (",s", "ऐ"), ("vks", "ओ"), ("vkS", "औ")]
CONSONANTS = [
    ("d", "क"), ("[k", "ख"), ("x", "ग"), ("?k", "घ"), ("³", "ङ"), ("p", "च"), ("N", "छ"), ("t", "ज"), (">", "झ"), ("¥", "ञ"), ("V", "ट"), ("B", "ठ"), ("M", "ड"), ("<", "ढ"), (".k", "ण"),
    ("r", "त"), ("Fk", "थ"), ("n", "द"), ("/k", "ध"), ("u", "न"), ("i", "प"), ("Q", "फ"), ("c", "ब"), ("Hk", "भ"), ("e", "म"), (";", "य"), ("j", "र"), ("y", "ल"), ("o", "व"),
    ("'k", "श"), ("\"k", "ष"), ("l", "स"), ("g", "ह"),
]
HALVES = [
    ("D", "क्"), ("[", "ख्"), ("£", "ख्"), ("X", "ग्"), ("?", "घ्"), ("Ä", "घ्"), ("P", "च्"), ("T", "ज्"), ("÷", "झ्"), (".", "ण्"), ("R", "त्"), ("F", "थ्"), ("/", "ध्"), ("U", "न्"), ("I", "प्"), ("¶", "फ्"), ("C", "ब्"),
    ("H", "भ्"), ("E", "म्"), ("¸", "य्"), ("Y", "ल्"), ("O", "व्"), ("'", "श्"), ("\"", "ष्"), ("L", "स्"), ("º", "ह्"),
]
CONJUNCTS = [
    ("{", "क्ष्"), ("{k", "क्ष"), ("«", "त्र्"), ("=", "त्र्"), ("=k", "त्र"), ("K", "ज्ञ"), ("J", "श्र"), ("Jh", "श्री"), ("|", "द्य"), ("}", "द्व"), (")", "द्ध"), ("í", "द्द"), ("æ", "द्र"), ("–", "दृ"), ("Ø", "क्र"), ("Ñ", "कृ"), ("—", "कृ"), ("ô", "क्क"),
    ("Ý", "फ्र"), ("ç", "प्र"), ("Á", "प्र"), ("iz", "प्र"), ("Ù", "त्त्"), ("Ùk", "त्त"), ("é", "न्न"), ("ê", "ट्ट"), ("ë", "ट्ठ"), ("ì", "ड्ड"), ("à", "ह्न"), ("á", "ह्य"), ("â", "हृ"), ("ã", "ह्म"), ("#", "रु"), (":", "रू"), ("ª", "्र"), ("z", "्र"), ("Lk", "स"),
]
SIGNS = [("k", "ा"), ("h", "ी"), ("q", "ु"), ("w", "ू"), ("`", "ृ"), ("s", "े"), ("S", "ै"), ("ks", "ो"), ("kS", "ौ"), ("‚", "ॉ"), ("W", "ॅ"), ("a", "ं"), ("¡", "ँ"), ("%", "ः"), ("~", "्"), ("+", "़"), ("±", "Zं")]
DIGITS = [("å", "०"), ("ƒ", "१"), ("„", "२"), ("…", "३"), ("†", "४"), ("‡", "५"), ("ˆ", "६"), ("‰", "७"), ("Š", "८"), ("‹", "९")]
MARKS = [("A", "।"), ("&", "-"), ("]", ","), ("-", "."), ("\\", "?"), ("^", "‘"), ("*", "’"), ("Þ", "“"), ("ß", "”"), ("¼", "("), ("½", ")"), ("¿", "{"), ("À", "}"), ("¾", "="), ("@", "/"), ("$", "+")]
#: Longer keys stand before the keys that begin them.
KEYS: list[tuple[str, str]] = sorted(VOWELS + CONSONANTS + HALVES + CONJUNCTS + SIGNS + DIGITS + MARKS, key=lambda x: -len(x[0]))
MATRA = "ािीुूृेैोौंँः"
CONSONANT = "\u0915-\u0939\u0958-\u095f"
#: Signs that an ordered table rewrites at once, at four bytes each and a few copies.
SIGNS = 1 << 18


class Ordered(list):
    """A table whose pairs apply in their order, each over the whole of what the earlier ones left, so what one prints may be a key of a later one.

    No key is empty. A key that an earlier one has used up never applies.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]] = ()):
        super().__init__(pairs)
        if any(not key for key, _ in self):
            raise ValueError("a key without a sign")

    def rewrite(self, texts: Sequence[str]) -> list[str]:
        """In slices of some ``SIGNS`` signs (or of one longer text), so that memory follows neither the batch nor the partition."""
        out, first, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SIGNS or i == len(texts) - 1:
                out += self.joined(texts[first : i + 1])
                first, size = i + 1, 0
        return out

    def joined(self, texts: Sequence[str]) -> list[str]:
        """All texts at once: they are joined by a sign that neither they nor the table hold, so each pair is one search for all of them."""
        held = set("".join(key + sign for key, sign in self)).union(*texts)
        mark = next((c for c in map(chr, range(0x10FFFF, 0xE000, -1)) if c not in held), None)
        if mark is None:
            return [self.joined([t])[0] for t in texts] if len(texts) > 1 else [functools.reduce(lambda t, p: t.replace(*p), self, texts[0])]
        return functools.reduce(lambda t, p: t.replace(*p), self, mark.join(texts)).split(mark) if texts else []


class Decoder:
    """One pass over the text, in which at each place the first key of the table that stands there prints its sign; then rules about the order of signs.
    A table that is :class:`Ordered` is applied pair by pair instead of in one pass.

    ``f`` (the i-sign, typed before its cluster) moves behind the cluster; ``Z`` (the upper r, typed after its syllable) moves before it as
    ``र्``; a half letter and a bar make the whole letter. Each rule is one bounded regular expression pass, so every input ends.
    """

    def __init__(self, table: Iterable[tuple[str, str]] = KEYS):
        self.table = table if isinstance(table, Ordered) else list(table)
        self.signs: dict[str, str] = {}
        for key, sign in self.table:
            self.signs.setdefault(key, sign)

    def __call__(self, raw: str | None) -> str | None:
        return self.batch([raw])[0]

    def batch(self, raw: Sequence[str | None]) -> list[str | None]:
        """Null and empty texts stay as they are."""
        printed = iter(self.printed([t for t in raw if t]))
        return [self.arranged(next(printed)) if t else t for t in raw]

    def printed(self, raw: Sequence[str]) -> Sequence[str]:
        if isinstance(self.table, Ordered):
            return self.table.rewrite(raw)
        keys = re.compile("|".join(re.escape(k) for k, _ in self.table)) if self.table else None
        return [keys.sub(lambda m: self.signs[m[0]], t) for t in raw] if keys else raw

    def arranged(self, text: str) -> str:
        text = text.replace("्ा", "")
        text = re.sub(rf"f((?:[{CONSONANT}]़?्)*[{CONSONANT}]़?)", r"\1ि", text).replace("f", "ि")
        text = re.sub(rf"((?:[{CONSONANT}]़?्)*[{CONSONANT}]़?)([{MATRA}]*)Z", r"र्\1\2", text)
        text = re.sub(rf"^([{MATRA}]*)Z", r"र्\1", text).replace("Z", "र्")
        text = re.sub(r"्{2,}", "्", text)
        text = re.sub(rf"्(?=[{MATRA}])", "", text)
        return re.sub(rf"[ ,](?=[{MATRA.replace('ं', '').replace('ः', '').replace('ँ', '')}])", "", text)


def read_mapping(path: str) -> Ordered:
    """A tab-separated file ``ord, raw, out``, to be applied in the order of ``ord``."""
    with open(path, encoding="utf-8", newline="") as f:
        return Ordered((r[1], r[2]) for r in sorted(csv.reader(f, delimiter="\t"), key=lambda r: int(r[0])))


def decode_legacy(table: Iterable[tuple[str, str]] = KEYS):
    """The decoder as a vectorised function of a column; the table travels with it."""
    decoder = Decoder(table)

    @F.pandas_udf("string")
    def decode(text: pd.Series) -> pd.Series:
        return pd.Series(decoder.batch(text.array), index=text.index, dtype=object)

    return decode


def decode_runs(groups: DataFrame, table: Iterable[tuple[str, str]] = KEYS) -> DataFrame:
    """Legacy groups through the decoder, others as they are; ``routed`` and ``plausibility`` for each.

    Only legacy rows reach Python: the two kinds are split and joined again by union.
    """
    decode = decode_legacy(table)
    routed = groups.where("legacy").withColumn("text", decode("text")).unionByName(groups.where(~F.col("legacy")))
    return routed.withColumn("routed", F.col("legacy")).withColumn("plausibility", plausibility("text"))


def grouped_lines(lines: DataFrame, table: Iterable[tuple[str, str]] = KEYS) -> DataFrame:
    """:func:`group_runs`, :func:`decode_runs` and :func:`lines_of` where a line's runs stand in one array ``runs`` (``run_no, text, font_name``): the other columns,
    ``text`` and ``min_plausibility``, without a shuffle. Only legacy texts reach Python."""
    decoder = Decoder(table)

    @F.pandas_udf("array<string>")
    def decode(texts: pd.Series) -> pd.Series:
        return pd.Series([None if own is None else decoder.batch(list(own)) for own in texts], index=texts.index, dtype=object)

    rest = [c for c in lines.columns if c != "runs"]
    used = F.array_sort(F.filter("runs", lambda x: F.length(x["text"]) > 0))
    rows = lines.select(*rest, F.transform(used, lambda x: F.struct(is_legacy_font(x["font_name"]).alias("legacy"), x["text"].alias("text"))).alias("_runs"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_runs") - 1), lambda i: (i == 0) | (F.get("_runs", i)["legacy"] != F.get("_runs", i - 1)["legacy"]))
    rows = rows.select("*", F.when(F.size("_runs") > 0, starts).otherwise(F.array().cast("array<int>")).alias("_starts"))

    def group(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_starts", i + 1), F.size("_runs"))
        text = F.array_join(F.transform(F.slice("_runs", start + 1, end - start), lambda x: x["text"]), "")
        return F.struct(F.get("_runs", start)["legacy"].alias("legacy"), text.alias("text"))

    rows = rows.select(*rest, F.transform("_starts", group).alias("_groups"))
    coded = F.when(F.exists("_groups", lambda g: g["legacy"]), F.transform("_groups", lambda g: F.when(g["legacy"], g["text"])))
    rows = rows.select("*", decode(coded).alias("_decoded"))
    texts = F.transform("_groups", lambda g, i: F.coalesce(F.get("_decoded", i), g["text"]))
    rows = rows.select(*rest, texts.alias("_texts"))
    least = F.array_min(F.transform("_texts", lambda t: F.when(~is_blank(t), plausibility(t))))
    return rows.select(*rest, F.array_join("_texts", "").alias("text"), F.coalesce(least, F.lit(1.0)).alias("min_plausibility"))


def lines_of(decoded: DataFrame, keys: Sequence[str] = ("source_file", "line_no")) -> DataFrame:
    """``keys, text, min_plausibility`` over the groups that are not blank (1 without any)."""
    parts = F.array_sort(F.collect_list(F.struct("group_no", "text")))
    least = F.min(F.when(~is_blank("text"), F.col("plausibility")))
    return decoded.groupBy(*keys).agg(parts.alias("p"), F.coalesce(least, F.lit(1.0)).alias("min_plausibility")).select(*keys, F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), "min_plausibility")
