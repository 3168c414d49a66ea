import re

from letterloom.functions import text as tx


def test_white_space_agrees_on_every_code_point(spark):
    chars = spark.createDataFrame([(c, f"{chr(c)}a{chr(c)}") for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF], "c int, s string")
    got = {r.c: (r.strip, r.lines) for r in chars.select("c", tx.ws_strip("s").alias("strip"), tx.text_lines("s").alias("lines")).collect()}
    for c, (strip, lines) in got.items():
        s = f"{chr(c)}a{chr(c)}"
        assert strip == s.strip(), hex(c)
        assert lines == [x for x in s.splitlines() if x.strip()], hex(c)


def test_tokens(spark):
    texts = ["शिक्षकों की कमी", "a_b C1 ٣४", "--- !!", "", "Été NAÏVE"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.tokenize("t").alias("t")).collect()]
    assert got == [re.findall(r"\w+", t.lower()) for t in texts]


def test_clean_line(spark):
    lines = ["a  b\tc\t\td ", " x \t\ny  ", "\t", "one\ttab"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(lines)), "i int, t string").orderBy("i").select(tx.clean_line("t").alias("c")).collect()]
    expected = [re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+(?=\n|\Z)", "", x)).strip() for x in lines]
    assert got == expected


def test_path_ids(spark):
    [r] = spark.createDataFrame([("a b/é/ц.docx",)], "p string").select("p", tx.encode_path("p").alias("e")).select("p", "e", tx.decode_path("e").alias("d")).collect()
    assert r.d == r.p and "+" not in r.e and "/" not in r.e
