from pyspark.sql import functions as F

from letterloom.operators import metadata


def extracted(spark, *letters):
    rows = spark.createDataFrame([(i, list(x)) for i, x in enumerate(letters)], "id int, lines array<string>")
    return [r.asDict() for r in metadata.extract(rows).orderBy("id").collect()]


def test_fields(spark):
    a, b, c, d = extracted(
        spark,
        ["पत्रांक-----/दिनांक----", "सेवा में,", "प्रबंधक,", "", "x", "विषय :-", "विषयवार सूची", "प्रसंग : पत्रांक 75 / दिनांक 23.03.2023"],
        ["सेवा में", "विषय: आरोप और अनुरोध", "सेवा में", "सचिव", "पटना", "बिहार", "भारत"],
        ["प्रेषक ,", "सेवा में", "प्रेषक", "एक", "दो", "सेवा में", "प्रतिलिपि :", "प्रतिलिपि - अ", "प्रतिलिपि: ब"],
        [],
    )
    assert a["subject"] == "वार सूची" and a["context_reference"] == "पत्रांक 75 / दिनांक 23.03.2023"  # no word boundary after the label
    assert (a["reference_number"], a["reference_date"]) == ("75", "23.03.2023") and a["recipient_designation"] == "प्रबंधक,"
    assert b["letter_type"] == "disciplinary_order" and b["recipient_designation"] == "सचिव पटना बिहार"
    assert c["sender_designation"] == "एक दो" and c["copy_to"] == ["अ", "ब"] and c["recipient_designation"] == "प्रेषक एक दो"
    assert d["letter_type"] == "general_correspondence" and d["field_confidence"] == {} and d["low_confidence_fields"] == []


def test_blank_header_is_null_and_flagged(spark):
    [a] = extracted(spark, ["पत्रांक------/दिनांक------"])
    assert a["reference_number"] is None and a["field_confidence"] == {"reference_number": False, "reference_date": False}


def test_line_with_a_break_inside(spark):
    [a] = extracted(spark, ["विषय: क\nख"])
    assert a["subject"] is None and "subject" not in a["field_confidence"] or a["field_confidence"]["subject"] is False


def test_overrides(spark):
    base = spark.createDataFrame([("a", "x", "s"), ("b", "y", None)], "letter_id string, department string, subject string")
    new = spark.createDataFrame([("a", None, "t")], "letter_id string, department string, subject string")
    got = {r.letter_id: (r.department, r.subject) for r in metadata.with_overrides(base, new).collect()}
    assert got == {"a": ("x", "t"), "b": ("y", None)}
    rows = spark.createDataFrame([({"k": "1"}, None), ({"k": "1"}, {"k": None, "n": "2"})], "a map<string,string>, o map<string,string>")
    assert [r.m for r in rows.select(metadata.merged_map("a", "o").alias("m")).collect()] == [{"k": "1"}, {"k": "1", "n": "2"}]
    assert rows.select(metadata.is_placeholder(F.lit("- _."))).first()[0]


def test_lines_are_split_once_for_each_letter(spark):
    """A filter that Spark infers from ``explode`` would repeat the extraction at the scan."""
    from letterloom import queries
    from tests.test_queries import SF

    for name in ("field_confidence", "low_confidence_fields", "plausibility", "placeholder"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "split(" in x], name


def test_lines_without_a_sign_of_the_block_need_no_expression(spark):
    from letterloom.functions import plausibility as pl

    texts = ["", "  ", "plain", "é ü ॐ", "१२", "\u08ff\u0980 \u0a00", "सेवा x", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pl.has_devanagari("t"), pl.plausibility("t")).orderBy("i").collect()
    assert [r[1] for r in got] == [False, False, False, True, True, False, True, None] and [r[2] for r in got[:3]] == [1.0] * 3
