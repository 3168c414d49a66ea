import pytest

from letterloom.functions import plausibility as pl
from letterloom.operators import fonts

# Words as the keyboard chart types them.
PAIRS = [
    ("fo|ky;", "विद्यालय"), ("LokLF;", "स्वास्थ्य"), ('jk"Vªh;', "राष्ट्रीय"), ("deZpkjh oxZ", "कर्मचारी वर्ग"), ("Ldwy esa fdrkc]", "स्कूल में किताब,"), ("bZ'oj", "ईश्वर"), ("'kqØokj", "शुक्रवार"),
    ("lM+d", "सड़क"), ("O;oLFkk¼[k½", "व्यवस्था(ख)"), ("iz/kkuk/;kid", "प्रधानाध्यापक"), ("i=kkpkj", "पत्राचार"), ("fnukad ƒ„&…†", "दिनांक १२-३४"),
]


@pytest.mark.parametrize(("raw", "expected"), PAIRS)
def test_pairs(raw, expected):
    assert fonts.Decoder()(raw) == expected


def test_decoder_always_ends():
    d = fonts.Decoder()
    assert d("") == "" and d(None) is None
    assert "Z" not in d("kZ") and "Z" not in d("vZ") and "f" not in d("f") and d("Zkkkk" * 50)
    assert d("dehZ") == "कर्मी"  # the upper r moves before its syllable


def test_own_table(tmp_path):
    (tmp_path / "m.tsv").write_text("2\ta\tX\n1\tab\tY\n", encoding="utf-8")
    assert fonts.Decoder(fonts.read_mapping(str(tmp_path / "m.tsv")))("aba") == "YX"


def test_ordered_table_applies_pair_by_pair():
    table = fonts.Ordered([("pk", "X"), ("pkS", "never"), ("sa", "T"), ("az", "U"), ("kas", "1"), ("=k", "=2"), ("=", "k"), ("k2", "3"), ("T", "az"), ("z", "w")])
    # the earlier pair wins an overlap, what it prints is a key of later ones, and no pair runs again over what comes after it
    expected = {"pkS": "XS", "saz": "aww", "kas": "1", "=kk": "3k", "=k": "3", "aza": "Ua", "": ""}
    assert table.rewrite(list(expected)) == list(expected.values())
    for raw, want in expected.items():
        for key, sign in table:
            raw = sign.join(raw.split(key))
        assert raw == want
    assert table.rewrite([]) == [] and fonts.Ordered().rewrite(["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        fonts.Ordered([("", "x")])


def test_ordered_table_keeps_texts_apart():
    table = fonts.Ordered([("ab", "c"), ("c", "d")])
    last = chr(0x10FFFF)  # the sign that would stand between texts is in use
    assert table.rewrite(["a", "b", f"{last}ab", "\n", "c"]) == ["a", "b", f"{last}d", "\n", "d"]
    decoder = fonts.Decoder(table)
    assert decoder.batch([None, "", "ab", "a", "b"]) == [None, "", "d", "a", "b"]


def test_ordered_table_in_a_query_is_that_text_by_text(spark):
    texts = ["pkS saz", None, "", "kas=kk", "the ant"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    table = fonts.Ordered([("th", "Fk"), *fonts.KEYS])
    got = {r.i: r.d for r in rows.select("i", fonts.decode_legacy(table)("t").alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == [fonts.Decoder(table)(t) for t in texts]
    assert got[4].startswith("थ")


def test_split_runs_decode_together(spark):
    rows = [("d", 0, 0, "DevLys 040", "f"), ("d", 0, 1, "DevLys 040", "tyk"), ("d", 0, 2, "Calibri", " A"), ("d", 0, 3, None, ""), ("d", 0, 4, "Kruti Dev 010", "lsok"), ("d", 1, 0, None, "x")]
    runs = spark.createDataFrame(rows, "source_file string, line_no int, run_no int, font_name string, text string")
    groups = fonts.group_runs(runs)
    assert [(r.line_no, r.group_no, r.legacy, r.text) for r in groups.orderBy("line_no", "group_no").collect()] == [(0, 0, True, "ftyk"), (0, 1, False, " A"), (0, 2, True, "lsok"), (1, 0, False, "x")]
    lines = {r.line_no: r for r in fonts.lines_of(fonts.decode_runs(groups)).collect()}
    assert lines[0].text == "जिला Aसेवा" and lines[1].text == "x" and lines[1].min_plausibility == 1.0


def test_plausibility_bounds(spark):
    texts = [b for _, b in PAIRS] + ["्रविष्वासभाजन", "विश्वासभाजन", "ंंंं", "", "Latin", "१२"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(pl.plausibility("t").alias("s")).collect()]
    score = dict(zip(texts, got, strict=True))
    assert all(0 <= s <= 1 for s in got)
    assert all(score[b] > 0.8 for _, b in PAIRS)
    assert score["विश्वासभाजन"] > score["्रविष्वासभाजन"] and score["ंंंं"] < 0.5 and score[""] == score["Latin"] == score["१२"] == 1.0


def test_lines_with_their_runs_need_no_shuffle(spark):
    from letterloom.sources import files

    a, b = [(2, "k", "DevLys 010"), (0, "fo", "Kruti Dev"), (1, "", "Arial"), (3, " x ", None), (4, "y", "Mangal"), (5, "d", "DevLys")], [(0, "", None)]
    schema = "source_file string, line_no int, runs array<struct<run_no: int, text: string, font_name: string>>, page_break_before boolean, ocr_plausibility double"
    lines = spark.createDataFrame([("f", 0, a, True, None), ("f", 1, b, False, None), ("f", 2, [], False, 0.5), ("g", 0, [(0, "विषय", None)], False, None)], schema)
    done = files.decoded_lines(lines)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    got = {(r.source_file, r.line_no): r for r in done.collect()}
    decode = fonts.Decoder()
    assert got["f", 0].text == decode("fok") + " x y" + decode("d") and got["f", 0].page_break_before and [got["f", i].text for i in (1, 2)] == ["", ""]
    assert got["f", 1].min_plausibility == 1.0 and got["f", 2].min_plausibility == 0.5 and got["g", 0].text == "विषय"
    rows = files.runs_of(lines.where("line_no = 0"), "ocr_plausibility")
    assert sorted(map(tuple, files.decoded_lines(rows).collect())) == sorted(tuple(r) for k, r in got.items() if k[1] == 0)


def test_memory_of_an_ordered_table_does_not_follow_the_batch():
    import tracemalloc

    table = fonts.Ordered([("ab", "c"), ("cc", "d"), ("x", "ab")])
    texts = [f"{i} " + "abab x" * 200 for i in range(5000)] + ["", "x"]
    tracemalloc.start()
    got = table.rewrite(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [f"{i} " + "d ab" * 200 for i in range(5000)] + ["", "ab"] and peak < 16 << 20
