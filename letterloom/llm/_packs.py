"""Packs: documents travel in compressed column blocks.

A *pack* is one row ``(pack long, body binary)`` whose body is a zstd-compressed Arrow stream of some
consecutive documents (about ``PACK_BYTES`` of them, or one longer document). Operators that need a global
answer about small pieces of text (lines, windows, words, shingles) work in three steps:

1. each pack *asks*: it sends its distinct pieces, as sorted runs of fingerprints, to buckets that cut the
   fingerprint space in equal ranges. A piece appears at most once per pack, however often the pack repeats it, so
   a bucket's load follows the number of packs, never the number of copies: that is the pre-aggregation that keeps a
   hot key from landing in one task.
2. each bucket *answers* every pack.
3. each pack *applies* its answers (a cogroup on the pack number).

Pack numbers come from the partition and the position of the rows in it. They repeat exactly when a task runs again, as long as the
input is read from files, where rows keep their places. The reduce side of a shuffle gets its blocks in another order each time, so
packs of an input with a shuffle in its plan are checkpointed before anything asks for them (:func:`packed`).
"""

from __future__ import annotations

import ctypes
import io
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import checkpoints

LIBC = ctypes.CDLL(None)
PACK_BYTES = 2 << 20
#: Bytes of fingerprints that one bucket should hold; the number of buckets follows the input from it.
BUCKET_BYTES = 8 << 20
ASK = "bucket int, pack long, blob binary"


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: 256 rows, as texts may be long."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < now <= 256:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one scan of the text column with a partial sum in each task."""
    return docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0


def bucket_count(total_bytes: float) -> int:
    return max(1, math.ceil(total_bytes / BUCKET_BYTES))


def dump(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue())


def load(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all().combine_chunks()


def shuffled(df: DataFrame) -> bool:
    """Whether rows can stand in another order when ``df`` is computed again: there is an exchange in its plan, cached parts included."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def settled(df: DataFrame) -> DataFrame:
    """``df`` with rows that keep their places: checkpointed if its plan has a shuffle."""
    if not shuffled(df):
        return df
    checkpoints(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, target: int = PACK_BYTES) -> DataFrame:
    """``df`` (all its columns, ``text`` among them) as packs; these are checkpointed if the plan of ``df`` has a shuffle."""

    def pack(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column("text")).fill_null(0)).astype(np.int64)
            start = 0
            for i, n in enumerate(lengths):
                size += int(n) + 32
                if size >= target:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row(part, seq, held)
                    held, size, start, seq = [], 0, i + 1, seq + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield row(part, seq, held)

    def row(part, seq, held):
        return pa.record_batch({"pack": pa.array([part << 32 | seq], pa.int64()), "body": pa.array([dump(pa.Table.from_batches(held))], pa.binary())})

    import pyarrow.compute  # noqa: F401  pa.compute is loaded on first import only

    arrow_limits(df.sparkSession)
    packs = df.mapInArrow(pack, "pack long, body binary")
    if shuffled(df):
        checkpoints(df.sparkSession)
        return packs.checkpoint()
    return packs


def trim() -> None:
    """Give freed memory back to the system: Python workers live on through many stages, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the pack's texts, and the ``n + 1`` offsets of the texts in them; null counts as empty."""
    col = table.column("text").cast(pa.large_string())
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, target: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of documents of about ``target`` bytes each, so that working arrays stay small."""
    out, first = [], 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[first] >= target or i == len(offsets) - 1:
            out.append((first, i))
            first = i
    return out


def doc_ids(table: pa.Table, null: int) -> np.ndarray:
    return np.asarray(table.column("doc_id").cast(pa.int64()).fill_null(null)).astype(np.int64)


def to_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the 64-bit space, in order: sorted keys give sorted buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def slices(sorted_keys: np.ndarray, n: int) -> dict[int, slice]:
    """Where each bucket that occurs stands among sorted keys; the work follows the keys, not the number of buckets."""
    return stretches(to_buckets(sorted_keys, n))


def stretches(buckets: np.ndarray) -> dict[int, slice]:
    if not len(buckets):
        return {}
    at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    return {b: slice(i, j) for b, i, j in zip(buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(buckets)], strict=True)}


def asked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, p, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch({"bucket": pa.array(b, pa.int32()), "pack": pa.array(p, pa.int64()), "blob": pa.array(x, pa.binary())})


def ask(packs: DataFrame, f) -> DataFrame:
    """``f(pack, table)`` gives the pack's questions as ``(bucket, blob)``."""

    def run(batches):
        for batch in batches:
            for pack, body in zip(batch.column("pack").to_pylist(), batch.column("body"), strict=True):
                yield asked([(b, pack, x) for b, x in f(pack, load(body.as_py()))])
                trim()

    return packs.mapInArrow(run, ASK)


def ask_again(packs: DataFrame, answers: DataFrame, f) -> DataFrame:
    """As :func:`ask`, with the answers of an earlier round: ``f(pack, table, {bucket: blob})``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for pack, body in zip(left.column("pack").to_pylist(), left.column("body"), strict=True):
            out += [(b, pack, x) for b, x in f(pack, load(body.as_py()), replies(right))]
        trim()
        return pa.Table.from_batches([asked(out)])

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, ASK)


def answer(questions: DataFrame, f) -> DataFrame:
    """``f(bucket, [(pack, blob), ...])``, in pack order, gives ``(pack, blob)`` replies."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([asked([])])
        bucket = table.column("bucket")[0].as_py()
        rows = sorted(zip(table.column("pack").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda x: x[0])
        out = pa.Table.from_batches([asked([(bucket, p, x) for p, x in f(bucket, rows)])])
        trim()
        return out

    return questions.groupBy("bucket").applyInArrow(run, ASK)


def replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))


def apply(packs: DataFrame, answers: list[DataFrame], f, schema: str, out: pa.Schema) -> DataFrame:
    """``f(pack, table, [{bucket: blob}, ...])`` gives the pack's result as an Arrow table of schema ``out``."""
    n = len(answers)
    told = None
    for i, a in enumerate(answers):
        # One column numbers the rounds, so that a single cogroup brings all of them.
        a = a.select("pack", (F.col("bucket").cast("long") * n + i).alias("bucket"), "blob")
        told = a if told is None else told.unionAll(a)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [{} for _ in range(n)]
        for b, x in replies(right).items():
            got[b % n][b // n] = x
        done = [f(p, load(x.as_py()), got) for p, x in zip(left.column("pack").to_pylist(), left.column("body"), strict=True)]
        trim()
        return pa.concat_tables([t.cast(out) for t in done]) if done else out.empty_table()

    return packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(run, schema)
