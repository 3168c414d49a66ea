import pytest
from pyspark.sql import functions as F

from letterloom.operators import store as st

BATCH = "pos int, letter_id string, document string, department string, office string, letter_type string, subject string, source_file string, needs_review boolean, extra map<string,string>, embedding array<float>"


def batch(spark, *rows):
    return spark.createDataFrame([(i, k, t, d, None, None, None, s, False, {}, v) for i, (k, t, d, s, v) in enumerate(rows)], BATCH)


@pytest.fixture
def store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"), "m", 2)
    s.upsert(batch(spark, ("a", "one", "edu", "f1", [1.0, 0.0]), ("b", "two", "rev", "f1", [0.0, 1.0]), ("c", "three", "edu", "f2", [0.0, 0.0])))
    return s


def ids(df):
    return [r.letter_id for r in df.collect()]


def test_order_filter_lookup(store):
    assert ids(store.find()) == ["a", "b", "c"] and ids(store.find({"department": "edu"})) == ["a", "c"]
    assert ids(store.find({"office": "none"})) == [] and ids(store.get(["c", "a", "c", "zz"])) == ["c", "a", "c"]
    assert store.distinct("department") == ["edu", "rev"] and store.distinct("office") == [] and store.count() == 3


def test_upsert_keeps_places_and_last_double_wins(spark, store):
    store.upsert(batch(spark, ("d", "x", "edu", "f3", [1.0, 1.0]), ("b", "old", "rev", "f1", [1.0, 0.0]), ("b", "new", "rev", "f1", [1.0, 0.0]), ("e", "y", "edu", "f3", [1.0, 1.0])))
    assert ids(store.find()) == ["a", "b", "c", "d", "e"]
    assert store.get(["b"]).first().document == "new"
    before = sorted(map(str, store.rows().collect()))
    store.upsert(batch(spark, ("b", "new", "rev", "f1", [1.0, 0.0])))
    assert sorted(map(str, store.rows().collect())) == before
    version = store.version()
    store.upsert(batch(spark).limit(0))
    assert store.version() == version


def test_delete(spark, store):
    version = store.version()
    store.delete_ids(["zz"])
    assert store.version() == version
    store.delete_where({"source_file": "f1"})
    assert ids(store.find()) == ["c"]
    store.delete_ids(["c"])
    assert store.count() == 0 and ids(store.query([1.0, 0.0], 3)) == []
    store.prune()
    assert store.count() == 0


def test_reopen_checks_the_model(spark, store):
    again = st.Store(spark, store.root, "m", 2)
    assert again.count() == 3
    for model, d in (("other", 2), ("m", 3)):
        with pytest.raises(st.EmbeddingModelMismatch):
            st.Store(spark, store.root, model, d)


def test_cosine(store):
    got = [(r.letter_id, round(r.distance, 6)) for r in store.query([1.0, 0.0], 3).collect()]
    assert got == [("a", 0.0), ("b", 1.0), ("c", 1.0)]  # a zero vector is as far as a right angle; ties by place
    assert [r.distance for r in store.query([0.0, 0.0], 1).collect()] == [1.0]
    with pytest.raises(ValueError):
        store.query([1.0, 0.0], 0)


def test_filter_builder():
    assert st.build_filter("", None) == {} and st.build_filter("x", "") == {"department": "x"}


def test_filters_reach_the_scan(store):
    plan = store.rows().where(st.matches({"department": "edu"})).select("letter_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(department,edu)" in plan and "embedding" not in plan.split("ReadSchema")[1]
    assert store.rows().select(F.count("*")).first()[0] == 3


def test_a_writer_that_dies_loses_nothing(spark, store):
    version, before = store.version(), sorted(map(str, store.rows().collect()))
    # Whatever was written before the header: rows, ids that are gone, a header that is not in place yet.
    store.rows().limit(1).write.parquet(f"{store.root}/v{version + 1}/rows")
    store.rows().select("letter_id").write.parquet(f"{store.root}/v{version + 1}/gone")
    with open(f"{store.root}/v{version + 1}/.HEADER", "w") as f:
        f.write("{")
    again = st.Store(spark, store.root, "m", 2)
    assert again.version() == version and sorted(map(str, again.rows().collect())) == before
    again.upsert(batch(spark, ("z", "new", "edu", "f9", [1.0, 1.0])))
    assert ids(again.find()) == ["a", "b", "c", "z"] and again.version() == version + 2


def test_versions_stay_readable_and_changes_are_small(spark, store):
    held = store.rows()
    store.delete_ids(["b"])
    store.upsert(batch(spark, ("b", "again", "rev", "f1", [0.0, 1.0]), ("a", "other", "rev", "f1", [0.0, 1.0])))
    assert ids(held.orderBy("ord")) == ["a", "b", "c"] and ids(store.find()) == ["a", "c", "b"]  # b came back as a new letter
    assert spark.read.parquet(f"{store.root}/v{store.version()}/rows").count() == 2
    for i in range(st.CHAIN + 3):
        store.upsert(batch(spark, (f"n{i}", "x", "edu", "f3", [1.0, 0.0])))
    assert store.count() == 3 + st.CHAIN + 3 and len(store._head()["chain"]) <= st.CHAIN + 1
    assert [r.letter_id for r in store.query([0.0, 1.0], 2).collect()] == ["a", "b"]
    store.prune()
    assert store.count() == 3 + st.CHAIN + 3


def test_vectors_are_computed_once(spark, store):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(_):
        calls.add(1)
        return [1.0, 0.0]

    rows = batch(spark, *[(f"k{i}", "t", "edu", "f5", None) for i in range(5)]).withColumn("embedding", embed("document"))
    store.upsert(rows)
    assert calls.value == 5 and store.count() == 8


def test_a_change_reads_only_the_files_of_its_keys(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "slots"), "m", 2, file_rows=50)
    s.upsert(batch(spark, *[(f"k{i:05d}", "t", "edu", f"f{i // 20}", [1.0, 0.0]) for i in range(2000)]))
    assert len(s.files()) >= 40
    bounds = s._files(s._head()["chain"][0])
    assert bounds[0].low == bounds[0].least and all(a.most < b.low for a, b in zip(bounds, bounds[1:], strict=False))
    new = batch(spark, *[(f"k{i:05d}", "new", "rev", "g", [0.0, 1.0]) for i in range(1000, 1020)], ("k01005x", "added", "rev", "g", [0.0, 1.0]))  # 1 %
    assert 0 < len(s.near(new).inputFiles()) < 0.05 * len(s.files())
    s.upsert(new)
    assert len(s._head()["touched"]) < 0.05 * len(bounds)
    # Readers join tombstones with the touched files only.
    plan = s.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and s.count() == 2001
    assert s.rows().where("document <> 't'").count() == 21 and [r.document for r in s.get(["k01003", "k00001", "k01005x"]).collect()] == ["new", "t", "added"]
    assert len(s.get(["k00001"]).inputFiles()) <= 3
    whole = {r.letter_id: r.ord for r in s.rows().collect()}
    assert len(set(whole.values())) == 2001 and whole["k01005x"] > max(v for k, v in whole.items() if k != "k01005x")


def test_changes_fold_into_the_slots_that_they_touch(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "slots"), "m", 2, file_rows=40)
    want = {}

    def put(keys, text):
        s.upsert(batch(spark, *[(k, text, "edu", "f", [1.0, 0.0]) for k in keys]))
        want.update(dict.fromkeys(keys, text))

    put([f"k{i:04d}" for i in range(400)], "t")
    first = set(s.files())
    for i in range(st.CHAIN):
        put([f"k0200{c}" for c in "abcdefghij"] + [f"k{210 + j:04d}" for j in range(3)] + ["a-before-all"], f"c{i}")
    s.delete_where({"letter_id": "k0005"})
    del want["k0005"]
    held = s._head()
    assert len(held["chain"]) == 1 and len(first & set(s.files())) >= len(first) - 4  # files that no key fell into stand as they were
    assert {r.letter_id: r.document for r in s.rows().collect()} == want
    put([f"k0300{i:03d}" for i in range(150)], "many")  # outgrows its slot
    for i in range(st.CHAIN):
        put([f"k0300{i:03d}"], f"d{i}")
    bounds = s._files(s._head()["chain"][0])
    assert max(f.n for f in bounds) <= 40 and all(a.most < b.low for a, b in zip(bounds, bounds[1:], strict=False))
    assert {r.letter_id: r.document for r in s.rows().collect()} == want
    s.delete_ids([k for k in want if k < "k0100"])
    s.prune(1)
    assert {r.letter_id for r in s.rows().collect()} == {k for k in want if k >= "k0100"}


def test_two_writers(spark, store, monkeypatch):
    other = st.Store(spark, store.root, "m", 2)
    publish, once = st.Store._publish, []

    def late(self, *args):  # the other writer publishes between this one's reading and publishing
        if not once:
            once.append(1)
            other.upsert(batch(spark, ("o", "theirs", "edu", "f9", [1.0, 0.0]), ("a", "theirs", "edu", "f1", [1.0, 0.0])))
        return publish(self, *args)

    monkeypatch.setattr(st.Store, "_publish", late)
    store.upsert(batch(spark, ("m", "mine", "edu", "f8", [1.0, 0.0]), ("b", "mine", "edu", "f1", [1.0, 0.0])))
    rows = {r.letter_id: r for r in store.rows().collect()}
    assert {k: r.document for k, r in rows.items()} == {"a": "theirs", "b": "mine", "c": "three", "o": "theirs", "m": "mine"}
    assert len({r.ord for r in rows.values()}) == 5
    seen = store.version()
    other.delete_ids(["c"])
    with pytest.raises(st.ConcurrentChange):
        store.upsert(batch(spark, ("c", "from an old reading", "edu", "f2", [0.0, 0.0])), since=seen)
    store.upsert(batch(spark, ("a", "fresh", "edu", "f1", [1.0, 0.0])), since=seen)
    assert ids(store.find()) == ["a", "b", "o", "m"] and not [n for n in __import__("os").listdir(store.root) if n.startswith("w-")]


def test_writers_at_once(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        st.Store(spark, store.root, "m", 2).upsert(batch(spark, (f"w{i}", "x", "edu", "f", [1.0, 0.0])))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    rows = store.rows().collect()
    assert sorted(r.letter_id for r in rows) == ["a", "b", "c", "w0", "w1", "w2", "w3"] and len({r.ord for r in rows}) == 7


def test_partitioned_folders(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "parts"), "m", 2, partition_by=["department"], file_rows=10)
    s.upsert(batch(spark, *[(f"k{i:03d}", "t", ["edu", "a b/c"][i % 2], "f", [1.0, 0.0]) for i in range(60)]))
    for i in range(st.CHAIN + 2):
        s.upsert(batch(spark, (f"k{i:03d}", f"n{i}", "rev", "f", [1.0, 0.0])))
    got = {r.letter_id: (r.document, r.department) for r in s.rows().collect()}
    assert len(got) == 60 and got["k003"] == ("n3", "rev") and got["k041"] == ("t", "a b/c") and s.distinct("department") == ["a b/c", "edu", "rev"]


def shuffled(df, column):
    """How often a column goes through a shuffle."""
    plan = df.sparkSession._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = [p for p in plan.split("\n\n") if p.startswith("(") and p.split("\n")[0].endswith("Exchange")]
    return sum(f"{column}#" in p.split("Arguments:")[0] for p in parts)


def test_texts_are_shuffled_once_to_meet_their_numbers(spark, store):
    rows = batch(spark, ("d", "x", "edu", "f3", [1.0, 1.0]), ("b", "old", "rev", "f1", [1.0, 0.0]), ("b", "new", "rev", "f1", [1.0, 0.0]), ("a", "y", "edu", "f3", [1.0, 1.0]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = st.changes(store.rows(), rows)
        assert shuffled(new, "document") == 1
        got = {r.letter_id: (r.ord, r.document) for r in new.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    held = {r.letter_id: r.ord for r in store.rows().collect()}
    assert set(got) == {"a", "b", "d"} and got["b"] == (held["b"], "new") and got["a"] == (held["a"], "y") and got["d"][0] > max(held.values())
    same = rows.withColumn("pos", F.lit(None).cast("int"))  # no place at all: still one row of each
    assert sorted(r.letter_id for r in st.changes(store.rows(), same).collect()) == ["a", "b", "d"]


def test_many_files_are_read_as_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "NAMED", 3)
    monkeypatch.setattr(st, "TASK_ROWS", 40)
    s = st.Store(spark, str(tmp_path / "many"), "m", 2, file_rows=10)
    s.upsert(batch(spark, *[(f"k{i:03d}", str(i), "edu", "f", [1.0, 0.0]) for i in range(200)]))
    files = s._files(s._head()["chain"][0])
    assert 20 <= len(files) <= 25 and max(f.n for f in files) <= 10  # tasks of 40 rows, each with one file that is not full
    for left in (0, 2, 5):
        own = files[left:]
        got = s._read(own)
        assert sorted(r.letter_id for r in got.collect()) == [f"k{i:03d}" for i in range(200 - sum(f.n for f in own), 200)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("InMemoryFileIndex(1 paths)" in plan) == (left < 5)
    s.upsert(batch(spark, ("k150", "changed", "edu", "f", [1.0, 0.0])))
    s.delete_ids(["k000"])
    assert s.count() == 199 and s.get(["k150"]).first().document == "changed"
