import itertools
import random

from pyspark.sql import functions as F

from letterloom.operators import export, long_files, segment
from letterloom.plans import ingest

HEAD = "पत्रांक----/दिनांक----"
SCHEMA = "source_file string, line_no int, text string"


def layouts():
    n, rows = 8, []
    for k in range(n + 1):
        for at in itertools.combinations(range(n), k):
            rows += [("".join(map(str, at)) or "none", i, HEAD if i in at else f"line number {i}") for i in range(n)]
    edges = {"one": ["x"], "twice": [HEAD, "a", HEAD], "equal": ["पत्रांक A दिनांक", "पत्रांक B दिनांक"] * 3, "short": ["abcd"] * 5, "blank": [""] * 4, "spaced": [f" {HEAD}\t"] * 4}
    return rows + [(f, i, t) for f, lines in edges.items() for i, t in enumerate(lines)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_segments_and_lines_for_any_blocks_and_partitions(spark):
    rows = layouts()
    lines = spark.createDataFrame(rows, SCHEMA)
    want = segment.segments(lines).select("source_file", "segment_index", "start_line", "end_line", "anchor_text", "gated")
    inside = rows_of(segment.assigned(lines, want).select("source_file", "line_no", "text", "segment_index"))
    random.Random(5).shuffle(rows)
    for block, parts in ((1, 5), (3, 2), (1 << 16, 7)):
        dealt = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = long_files.segments(dealt, block=block)
        assert got.dtypes == want.dtypes
        assert rows_of(got) == rows_of(want)
        assert rows_of(long_files.assigned(dealt, got, block).select("source_file", "line_no", "text", "segment_index")) == inside


def test_letters_by_rows_are_those_by_files(spark):
    lines = spark.createDataFrame(layouts(), SCHEMA).withColumn("min_plausibility", (F.col("line_no") % 4 / 4.0))
    assert rows_of(ingest.letters_of_lines(lines, by_rows=True)) == rows_of(ingest.letters_of_lines(lines))


def test_running_sum(spark):
    rows = [(k, o, (o * 7) % 5 - 1) for k in ("a", "b") for o in range(-20, 40, 1 if k == "a" else 3)]
    got = long_files.running_sum(spark.createDataFrame(rows, "k string, o long, v int").repartition(3), ["k"], "o", "v", "s", block=6)
    want = [(k, o, v, sum(w for j, p, w in rows if j == k and p <= o)) for k, o, v in rows]
    assert rows_of(got.select("k", "o", "v", "s")) == sorted(want, key=repr)


def test_no_shuffle_by_file_alone(spark):
    """Lines and segments are dealt by file and block or by file and number; only sums of blocks and headers meet by file."""
    lines = spark.createDataFrame(layouts(), SCHEMA)
    plan = long_files.assigned(lines, long_files.segments(lines))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "windowspecdefinition" in x and "_sum" not in x]
    assert windows and all("_block" in x.split("windowspecdefinition(")[1].split(", specifiedwindowframe")[0].split(" ASC")[0] for x in windows)


def test_files_of_a_table_are_ingested(spark):
    """Word-processor files made in the tasks; control signs, which XML can't hold, don't make them unreadable; by rows or by files."""
    rows = [("a/b/x.docx", ".docx", "one\x00\x0b\n\ntwo"), ("a/y.docx", ".docx", ""), ("a/z.docx", ".docx", " \n"), ("a/b/t.txt", ".txt", None)]
    drafts = spark.createDataFrame(rows, "source_file string, suffix string, draft string")
    files = drafts.where("suffix = '.txt' OR draft IS NOT NULL").select("source_file", "suffix", F.coalesce(export.docx_column("draft"), F.lit(b"")).alias("content"))
    want = [("t__seg000", "a", "b", ""), ("x__seg000", "a", "b", "one\ntwo")]
    for by_rows in (False, True):
        got = ingest.ingest_files(files, by_rows=by_rows).select("letter_id", "department", "office", "text")
        assert rows_of(got) == want


def test_no_lines(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert long_files.segments(none).count() == 0 and long_files.assigned(none, long_files.segments(none)).count() == 0
