"""Labelled fields of a letter by auditable patterns, and human corrections on top.

Everything works inside one row on the array of the letter's cleaned lines, so no step shuffles. ``(?d)`` makes ``.`` and ``$`` treat
``\\n`` alone as the end of a line. What isn't filled in comes back as null, never as a guess.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, col, is_blank, non_empty, ws_strip

# The labels and keywords of official letters.
SUBJECT = rf"(?d)^{WS}*विषय{WS}*[:\-।]*{WS}*(.*)$"
CONTEXT = rf"(?d)^{WS}*प्रसंग{WS}*[:\-।]*{WS}*(.*)$"
SERVICE_TO = rf"सेवा{WS}*में"
SENDER = rf"(?d)^{WS}*प्रेषक{WS}*[,:]*{WS}*$"
COPY_TO = rf"(?d)^{WS}*प्रतिलिपि{WS}*[:\-]*{WS}*(.*)$"
NOT_WS = WS.replace("[", "[^", 1)
REFERENCE = rf"(?d)पत्रांक{WS}*[:\-.]*{WS}*({NOT_WS.replace(']', '/]')}*){WS}*/?{WS}*दिनांक{WS}*[:\-.]*{WS}*({NOT_WS}*)"
PLACEHOLDER = rf"(?d)^(?:[.\-_]|{WS})*$"
SUBJECT_WORD = rf"^{WS}*विषय(?![\p{{L}}\p{{N}}_])"
DISCIPLINARY = ["आदेश", "आरोप", "अभिकथन", "निलंबित", "दोषी"]
FORWARDING = ["अग्रसारित", "अनुरोध", "प्रेषित", "अग्रलेख"]

#: Words that a line must hold for the pattern to match: they are looked for in the bytes first, as most lines hold none.
HOLDS = {SUBJECT: ["विषय"], CONTEXT: ["प्रसंग"], SERVICE_TO: ["सेवा"], SENDER: ["प्रेषक"], COPY_TO: ["प्रतिलिपि"], REFERENCE: ["पत्रांक", "दिनांक"]}

FIELDS = ["subject", "context_reference", "reference_number", "reference_date", "recipient_designation", "sender_designation"]


def first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def is_placeholder(c: Column | str) -> Column:
    return col(c).isNull() | col(c).rlike(PLACEHOLDER)


def fits(line: Column, pattern: str) -> Column:
    found = line.rlike(pattern)
    for w in reversed(HOLDS[pattern]):
        found = line.contains(w) & found
    return found


def labelled(lines: Column, pattern: str) -> Column:
    """The first non-empty rest of a line that the pattern matches."""
    return first(F.transform(lines, lambda x: F.when(fits(x, pattern), non_empty(F.regexp_extract(x, pattern, 1)))))


def any_line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: fits(x, pattern))


def following(lines: Column, i: Column, stops: Callable[[Column], Column]) -> Column:
    """Up to three lines after line i, as far as the first that stops them, stripped and joined by blanks; null if there are none."""
    taken = F.aggregate(
        F.slice(lines, i + 2, 3),
        F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("taken")),
        lambda acc, x: F.when(acc["done"] | stops(x), F.struct(F.lit(True).alias("done"), acc["taken"].alias("taken"))).otherwise(
            F.struct(F.lit(False).alias("done"), F.concat(acc["taken"], F.array(ws_strip(x))).alias("taken"))
        ),
        lambda acc: acc["taken"],
    )
    return non_empty(F.array_join(taken, " "))


def letter_type(text: Column | str) -> Column:
    def any_of(words):
        found = F.lit(False)
        for w in words:
            found = found | col(text).contains(w)
        return found

    return F.when(any_of(DISCIPLINARY), "disciplinary_order").when(any_of(FORWARDING), "forwarding_request").otherwise("general_correspondence")


def extract(letters: DataFrame, lines: str = "lines") -> DataFrame:
    """``letters`` with the six fields, ``copy_to``, ``letter_type``, ``field_confidence`` (only labels that occur) and ``low_confidence_fields``."""
    x = F.col(lines)
    references = F.transform(
        F.filter(x, lambda v: fits(v, REFERENCE)),
        lambda v: F.struct(*[F.when(~is_placeholder(F.regexp_extract(v, REFERENCE, g)), F.regexp_extract(v, REFERENCE, g)).alias(n) for g, n in ((1, "number"), (2, "date"))]),
    )
    reference = F.get(F.filter(references, lambda r: r["number"].isNotNull() | r["date"].isNotNull()), F.lit(0))
    to = first(F.transform(x, lambda v, i: F.when(fits(v, SERVICE_TO), following(x, i, lambda y: is_blank(y) | fits(y, SUBJECT) | fits(y, CONTEXT)))))
    by = first(F.transform(x, lambda v, i: F.when(fits(v, SENDER), following(x, i, lambda y: is_blank(y) | fits(y, SERVICE_TO)))))
    copies = F.filter(F.transform(x, lambda v: F.when(fits(v, COPY_TO), non_empty(F.regexp_extract(v, COPY_TO, 1)))), lambda v: v.isNotNull())
    done = letters.select(
        "*", labelled(x, SUBJECT).alias("subject"), labelled(x, CONTEXT).alias("context_reference"),
        reference["number"].alias("reference_number"), reference["date"].alias("reference_date"),
        to.alias("recipient_designation"), by.alias("sender_designation"), copies.alias("copy_to"), letter_type(F.array_join(x, "\n")).alias("letter_type"),
    )
    seen = dict(zip(FIELDS, [SUBJECT, CONTEXT, REFERENCE, REFERENCE, SERVICE_TO, SENDER], strict=True))
    entries = F.array(*[F.when(any_line(x, p), F.struct(F.lit(f).alias("key"), F.col(f).isNotNull().alias("value"))) for f, p in seen.items()])
    done = done.withColumn("field_confidence", F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())))
    return done.withColumn("low_confidence_fields", F.map_keys(F.map_filter("field_confidence", lambda _, ok: ~ok)))


def with_overrides(letters: DataFrame, overrides: DataFrame, fields=("department", "office", "letter_type", "subject"), key: str = "letter_id") -> DataFrame:
    """Corrections win where they are not null. A letter without any is left as it is; several for one letter are an error of the caller's."""
    renamed = overrides.select(key, *[F.col(f).alias(f"new_{f}") for f in fields if f in overrides.columns])
    joined = letters.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in joined.columns and c in fields else F.col(c) for c in letters.columns])


def merged_map(auto: Column | str, override: Column | str) -> Column:
    """Map form of the merge: override entries that are not null win, and may add keys. Works whatever the session's rule for doubled keys is."""
    new = F.map_filter(F.coalesce(col(override), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(col(auto), lambda k, _: ~F.map_contains_key(new, k)), new)


def scalar_metadata(m: Column | str) -> Column:
    """What the store keeps of an open map: entries that are not null."""
    return F.map_filter(col(m), lambda _, v: v.isNotNull())
