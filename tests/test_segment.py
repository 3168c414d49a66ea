import itertools

from letterloom.operators import segment

HEAD = "पत्रांक----/दिनांक----"


def spans(spark, files):
    rows = [(f, i, t) for f, lines in files.items() for i, t in enumerate(lines)]
    lines = spark.createDataFrame(rows, "source_file string, line_no int, text string")
    out = {}
    for r in segment.segments(lines).orderBy("source_file", "segment_index").collect():
        out.setdefault(r.source_file, []).append((r.start_line, r.end_line))
    return out, lines


def walked(n, at):
    """The bounds by walking over the anchors: each letter starts two lines before its header, but after the one before it started."""
    if len(at) < 3:
        return [(0, n - 1)]
    starts = []
    for a in at:
        start = max(0, a - 2)
        starts.append(max(start, starts[-1] + 1) if starts else start)
    return [(s, e - 1) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def test_bounds_for_all_small_layouts(spark):
    n, files, expected = 8, {}, {}
    for k in range(n + 1):
        for at in itertools.combinations(range(n), k):
            name = "".join(map(str, at)) or "none"
            files[name] = [HEAD if i in at else f"line number {i}" for i in range(n)]
            expected[name] = walked(n, at)
    got, _ = spans(spark, files)
    assert got == expected


def test_edges(spark):
    files = {
        "one": ["x"], "twice": [HEAD, "a", HEAD], "gaps": [HEAD, HEAD, "a", HEAD, "", HEAD], "late": ["a", "b", "c", "d", HEAD, "e", HEAD, HEAD],
        "equal": ["पत्रांक A दिनांक", "पत्रांक B दिनांक"] * 3, "short": ["abcd"] * 5, "words": ["only पत्रांक here"] * 4,
    }
    got, lines = spans(spark, files)
    assert got["one"] == [(0, 0)] and got["twice"] == [(0, 2)] and got["short"] == [(0, 4)] and got["words"] == [(0, 3)]
    assert got["late"][0][0] == 2  # lines before the first start belong to none
    texts = {r.source_file: r.anchor_text for r in segment.anchor_text(lines).collect()}
    assert texts["equal"] == "पत्रांक A दिनांक" and "twice" not in texts
    for bounds in got.values():
        assert all(a[1] + 1 == b[0] for a, b in itertools.pairwise(bounds))
    cut = segment.segment_lines(lines, segment.segments(lines))
    assert sum(len(r.lines) for r in cut.where("source_file = 'late'").collect()) == 6


def test_no_lines(spark):
    lines = spark.createDataFrame([], "source_file string, line_no int, text string")
    assert segment.segments(lines).count() == 0
