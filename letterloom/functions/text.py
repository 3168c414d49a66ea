"""Column helpers for text that agree with Unicode-aware string handling, code point for code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same signs as text, for trimming.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Where a text breaks into lines.
NL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
TOKEN = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (``trim`` by itself knows the blank only)."""
    return F.btrim(col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """Trimming at the left ends at the first sign that is not blank, so a long line costs no more than a short one."""
    return F.length(F.ltrim(col(c), F.lit(BLANKS))) == 0


def non_empty(c: Column | str) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(ws_strip(c), F.lit(""))


def split_lines(c: Column | str) -> Column:
    """All lines; a break at the very end gives one more, empty, line."""
    return F.split(col(c), NL)


def text_lines(c: Column | str) -> Column:
    """Lines that are not blank, as they stand."""
    return F.filter(split_lines(c), lambda x: ~is_blank(x))


def clean_line(c: Column | str) -> Column:
    """No blanks or tabs before a break, runs of them as one blank (a single tab stays), stripped."""
    c = col(c)
    broken = F.when(c.contains("\n"), F.regexp_replace(c, r"(?<![ \t])[ \t]+(?=\n)", "")).otherwise(c)  # stripping does the end
    return ws_strip(F.regexp_replace(broken, r"[ \t]{2,}", " "))


def clean_lines(lines: Column | str) -> Column:
    return F.filter(F.transform(col(lines), clean_line), lambda x: x != "")


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores. Combining marks separate, as in Python's ``\\w``."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def term_counts(tokens: Column | str) -> Column:
    """``array<struct<term, tf>>`` of the different tokens, sorted: equal ones stand together in the sorted array, so a row counts its own without a shuffle."""

    def runs(own: Column) -> Column:
        begins = F.filter(F.transform(own, lambda x, i: F.when(F.coalesce(F.get(own, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(begins), lambda b: F.transform(b, lambda at, j: F.struct(F.get(own, at).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(own)) - at).alias("tf")))), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(col(tokens))), runs), F.lit(0))  # bound once, not sorted again for each element


def snippet(c: Column | str, length: int = 200) -> Column:
    return F.when(F.length(col(c)) > length, F.concat(F.left(col(c), F.lit(length)), F.lit("…"))).otherwise(col(c))


def letter_id(stem: Column | str, index: Column | str) -> Column:
    return F.format_string("%s__seg%03d", col(stem), col(index))


def encode_path(path: Column | str) -> Column:
    """URL-safe base64 of a relative path, as a document id."""
    return F.translate(F.base64(F.encode(col(path), "UTF-8")), "+/", "-_")


def decode_path(doc_id: Column | str) -> Column:
    return F.decode(F.unbase64(F.translate(col(doc_id), "-_", "+/")), "UTF-8")
