"""The operators on packs on several executors, over several files and over shuffled input: the rows of one file in one process."""

import json
import os
import subprocess
import sys
from pathlib import Path

from letterloom.llm import _packs, queries
from tests.test_queries import SF

NAMES = ["op1_suffix_dedup", "op2_substring_dedup", "op4_bpe", "op9_jaccard_join", "op10_line_dedup", "op12_periodic_runs"]
JOB = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
from letterloom.llm import _packs, line_dedup, substring_dedup
folder, shared, *names = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", shared).config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
_packs.packed.__defaults__ = (1 << 15,)
queries = __spark_entry__.queries()
out = {name: sorted(str(sorted(r.asDict().items())) for r in queries[name](spark, folder).collect()) for name in names}
mixed = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
out["lines"] = [sorted(f"{r.doc_id} {r.n_dropped} {r.text}" for r in line_dedup.line_dedup(mixed).collect()) for _ in range(2)]
out["words"] = sorted(f"{r.doc_id} {r.spans}" for r in substring_dedup.substring_dedup(mixed).collect())
print("RESULT" + json.dumps(out))
"""


def test_like_one_process(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/in/documents.parquet")
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run(
        [sys.executable, "-c", JOB, f"{tmp_path}/in", f"file://{tmp_path}/shared", *NAMES], cwd=tmp_path, env=os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}, capture_output=True, text=True, timeout=900, check=False
    )
    assert "RESULT" in done.stdout, done.stderr[-3000:]
    got = json.loads(done.stdout.rpartition("RESULT")[2])
    monkeypatch.setattr(_packs.packed, "__defaults__", (1 << 15,))
    for name in NAMES:
        assert got[name] == sorted(str(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect()), name
    from letterloom.llm import line_dedup, substring_dedup

    assert got["lines"] == [sorted(f"{r.doc_id} {r.n_dropped} {r.text}" for r in line_dedup.line_dedup(docs).collect())] * 2
    assert got["words"] == sorted(f"{r.doc_id} {r.spans}" for r in substring_dedup.substring_dedup(docs).collect())
