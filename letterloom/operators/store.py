"""A versioned Parquet store of letters with their vectors.

``root/v<n>`` holds what version n changed: ``rows`` (new or replaced letters) and ``gone`` (ids whose older rows no longer count). Its header,
``root/v<n>/HEADER``, is put in place last, by a rename to a name that is not taken, and lists the versions that make up the state; the newest version with a
header is the current one. Nothing is ever overwritten or removed by a change, so a writer that dies at any moment leaves the version before it, and
readers see one version or the other.

*Slots.* The base of a state is cut by ``letter_id`` into slots, a file each: a key belongs to the slot with the largest lower bound up to it, and
``FILES`` lists each file's bounds. A change finds the slots of its keys and reads these files only (:meth:`Store.near`), to know which keys are held and their
places; readers join tombstones with the slots that changes have touched and take all others as they are. After ``CHAIN`` changes the next one
folds them in: it rewrites the touched slots (one that has outgrown ``file_rows`` is split) and lists the other files again, wherever they stand.

*Writers.* A change is computed on the state it has seen and written to a folder of its own. To publish it a writer claims the next number by a file that
only one can create, waits for smaller claims (until they expire) and gives up if the state has moved on meanwhile; the change is then computed anew
on the new state, so both writers' changes stay. Who has read rows before can name that version (``since``): if one of the keys was changed
after it, the change is refused with :class:`ConcurrentChange`.

Filters reach the scan as Parquet predicates since the fields are columns of their own; ``partition_by`` adds pruning. Scores are computed in double
precision from the float vectors.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from itertools import groupby
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col

SCHEMA = (
    "ord bigint, letter_id string, document string, department string, office string, letter_type string, subject string, "
    "source_file string, needs_review boolean, extra map<string,string>, embedding array<float>"
)


#: Changes on top of a base before the next one folds them in.
CHAIN = 8
#: Rows of a slot's file.
FILE_ROWS = 200_000
#: Rows that one task writes, where files are smaller, and bytes of a row group: the least part of a file that a task of its own can read.
TASK_ROWS, ROW_GROUP = 5_000, 1 << 24
#: Files beyond which a folder is read as one, without the few that don't count, as each path that is named costs the driver time.
NAMED = 100
#: Seconds that a writer may take to publish what it has written, and how often a change is computed anew.
LEASE, RETRIES = 60.0, 20
#: Seconds after which a folder that no writer has published counts as left behind.
STALE = 86_400.0


class EmbeddingModelMismatch(ValueError):
    """The store was built with another model or dimension."""


class ConcurrentChange(RuntimeError):
    """Another writer has changed the same letters meanwhile."""


class Moved(Exception):
    """The state is no longer the one that a change was computed on."""


class File(NamedTuple):
    """A file of rows: its path below the store's root, its slot's lower bound, its least and largest key, and how many rows it has."""

    path: str
    low: str
    least: str
    most: str
    n: int


def matches(where: dict | None) -> Column:
    """All equalities hold; a missing value never matches; no filter matches everything."""
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in (where or {}).items()), F.lit(True))


def build_filter(department: str | None = None, letter_type: str | None = None) -> dict:
    """Only what is given and not empty."""
    return {k: v for k, v in (("department", department), ("letter_type", letter_type)) if v}


def list_distinct(rows: DataFrame, field: str) -> DataFrame:
    """Distinct non-empty values in order of code points."""
    return rows.where(F.col(field).isNotNull() & (F.col(field) != "")).select(field).distinct().orderBy(field)


def lookup(rows: DataFrame, ids: DataFrame, key: str = "letter_id") -> DataFrame:
    """Rows for ``ids`` (``pos, <key>``) with their ``pos``, in that order; doubles stay, unknown ids drop."""
    return ids.join(rows, key).orderBy("pos")


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "letter_id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def without_matches(rows: DataFrame, where: dict) -> DataFrame:
    return rows.where(~F.coalesce(matches(where), F.lit(False)))


def changes(base: DataFrame, batch: DataFrame, key: str = "letter_id", order: str = "ord", pos: str = "pos", top: int | None = None) -> DataFrame:
    """The batch's rows as they stand in the store: of a key's rows the last counts; known keys keep their ``order``, new ones follow in batch order after
    ``top`` (the largest number of ``base`` if not given; ``base`` may then be any part of the state that has the batch's keys).

    New numbers rise in batch order and have gaps: a range-partitioned sort and the row's place in its partition give them without bringing
    rows together. Only keys and places are grouped, joined with ``base`` and sorted; the rows themselves are shuffled once, to meet their numbers.
    """
    columns, at = [c for c in base.columns if c != order], F.struct(pos)  # in a struct a missing place is the least and equals itself
    keys = batch.groupBy(key).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    top = base.agg(F.coalesce(F.max(order), F.lit(-1)).alias("m")).first().m if top is None else top
    held = keys.join(base.select(key, F.col(order).alias("_held")), key, "left").orderBy("_first")
    number = F.coalesce("_held", F.monotonically_increasing_id() + F.lit(top + 1))
    numbered = held.select(key, F.col("_last").alias("_at"), number.alias(order))
    w = Window.partitionBy(key, "_at").orderBy("_at")  # as the join has dealt and sorted them
    last = batch.select(*columns, at.alias("_at")).join(numbered, [key, "_at"]).withColumn("_one", F.row_number().over(w)).where("_one = 1")
    return last.select(*base.columns)


def upserted(base: DataFrame, batch: DataFrame, key: str = "letter_id", order: str = "ord", pos: str = "pos") -> DataFrame:
    """``base`` with the batch's rows in place of those with the same key. The batch is read twice; it should be a table or a checkpoint."""
    return base.join(batch.select(key), key, "left_anti").select(*base.columns).unionByName(changes(base, batch, key, order, pos))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where either side has length 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosine_query(rows: DataFrame, vector: Sequence[float], k: int, where: dict | None = None, key: str = "letter_id", order: str = "ord") -> DataFrame:
    """The k nearest that match, with ``distance``: a filter, one pass and a bounded sort. Payload comes by a join on the k keys."""
    if k < 1:
        raise ValueError("k must be at least 1")
    query = F.from_json(F.lit(json.dumps([float(v) for v in vector])), "array<double>")
    return rows.where(matches(where)).withColumn("distance", 1 - similarity("embedding", query)).orderBy("distance", order).limit(k)


def slot_of(lows: list[str]) -> Callable[[Column | str], Column]:
    """The number of a key's slot: that of the last of the sorted bounds up to the key. As many bounds as there are files travel to the tasks."""
    if len(lows) <= 1:
        return lambda key: F.lit(0)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series([max(bisect_right(lows, k or "") - 1, 0) for k in keys], dtype="int32")

    return lambda key: find(col(key))


class Store:
    def __init__(self, spark: SparkSession, root: str, embedding_model: str, dimension: int, partition_by: Sequence[str] = (), file_rows: int = FILE_ROWS):
        self.spark, self.root, self.model, self.dimension, self.partition_by, self.file_rows = spark, root.rstrip("/"), embedding_model, dimension, list(partition_by), file_rows
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if (head := self._head()) is None:
            self._publish(None, self._staged(), {"chain": [], "top": -1, "touched": []}, [])
        elif (head["embedding_model"], head["embedding_dimension"]) != (embedding_model, dimension):
            raise EmbeddingModelMismatch(f"store has {head['embedding_model']} ({head['embedding_dimension']}), asked for {embedding_model} ({dimension})")

    # Names and small files.
    def _versions(self) -> list[int]:
        """All version folders, complete or not, newest first."""
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{path}"))

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{path}"), True)

    def _get(self, path: str):
        return json.loads(self.spark.read.text(f"{self.root}/{path}", wholetext=True).first().value)

    def _put(self, path: str, value) -> None:
        out = self._fs.create(self._path(f"{self.root}/{path}"), True)
        out.write(json.dumps(value).encode())
        out.close()

    def _rename(self, path: str, to: str) -> None:
        if self._exists(to) or not self._fs.rename(self._path(f"{self.root}/{path}"), self._path(f"{self.root}/{to}")):
            raise OSError(f"cannot set {to}")

    def _head(self) -> dict | None:
        return next((self._get(f"v{v}/HEADER") for v in self._versions() if self._exists(f"v{v}/HEADER")), None)

    def version(self) -> int | None:
        return None if (head := self._head()) is None else head["version"]

    # Files and rows.
    def _files(self, version: int) -> list[File]:
        return [File(*f) for f in self._get(f"v{version}/FILES")]

    def files(self) -> list[str]:
        """Paths of all files of rows that make up the state."""
        return [f.path for v in self._head()["chain"] for f in self._files(v)]

    def _read(self, files: list[File]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        if not self.partition_by:  # no folder name counts as a column
            reader = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True)
            named, read = [], []
            for v, own in groupby(sorted(f.path for f in files), lambda p: p.split("/")[0]):
                own = set(own)
                other = {f.path for f in self._files(int(v[1:])) if f.path.startswith(f"{v}/")} - own if len(own) > NAMED else own
                if len(other) <= NAMED < len(own) and all(p.count("/") == 2 for p in own | other):
                    whole = reader.parquet(f"{self.root}/{v}/rows")
                    names = sorted(p.rpartition("/")[2] for p in other)
                    read.append(whole.where(~F.col("_metadata.file_name").isin(names)) if names else whole)  # Spark leaves these files out of its list
                else:
                    named += sorted(own)
            read += [reader.parquet(*[f"{self.root}/{p}" for p in named])] if named else []
            return reduce(DataFrame.unionByName, read)
        parts: dict[str, list[str]] = {}
        for f in files:
            parts.setdefault(f.path.split("/")[0], []).append(f"{self.root}/{f.path}")
        read = [self.spark.read.schema(SCHEMA).option("basePath", f"{self.root}/{v}/rows").parquet(*paths) for v, paths in parts.items()]
        return reduce(DataFrame.unionByName, (x.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]) for x in read))

    def _gone(self, version: int) -> DataFrame:
        return self.spark.read.schema("letter_id string").parquet(f"{self.root}/v{version}/gone")

    def _merged(self, head: dict, files: list[File], within: tuple[str, str] | None = None) -> DataFrame:
        """What counts of some files of the base and of all changes (or of those of their files that overlap a range of keys): of each letter the row
        of the newest version that has one, unless a version since says that it is gone."""
        first, *later = head["chain"]
        if not later:
            return self._read(files)
        fits = lambda f: within is None or f.least <= within[1] and within[0] <= f.most
        every = self._read(files).withColumn("_v", F.lit(first))
        for v in later:
            if own := [f for f in self._files(v) if fits(f)]:
                every = every.unionByName(self._read(own).withColumn("_v", F.lit(v)))
        gone = reduce(DataFrame.unionByName, (self._gone(v).withColumn("_gone", F.lit(v)) for v in later))
        gone = gone.groupBy("letter_id").agg(F.max("_gone").alias("_gone"))
        kept = every.join(gone, "letter_id", "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_v")))
        return kept.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])

    def rows(self) -> DataFrame:
        """The whole state. Only files that changes have touched are joined with what is gone."""
        head = self._head()
        base, touched = self._files(head["chain"][0]), set(head["touched"])
        if len(head["chain"]) == 1:
            return self._read(base)
        calm = [f for i, f in enumerate(base) if i not in touched]
        rest = self._merged(head, [f for i, f in enumerate(base) if i in touched])
        return self._read(calm).unionByName(rest) if calm else rest

    def _slots(self, head: dict, keys: DataFrame) -> tuple[list[File], set[int], tuple[str, str] | None]:
        """The base, the numbers of the slots that keys fall into, and the least and largest key."""
        base = self._files(head["chain"][0])
        found = keys.agg(F.collect_set(slot_of([f.low for f in base])("letter_id")).alias("s"), F.min("letter_id").alias("a"), F.max("letter_id").alias("b")).first()
        return base, set(found.s) if base else set(), None if found.a is None else (found.a, found.b)

    def near(self, keys: DataFrame, head: dict | None = None) -> DataFrame:
        """A part of the state that has all rows with these ``letter_id``: only files whose bounds they fall into are read."""
        head = head or self._head()
        base, slots, within = self._slots(head, keys)
        return self._merged(head, [base[i] for i in sorted(slots)], within or ("", ""))

    # Changes.
    def _staged(self) -> str:
        return f"w-{uuid.uuid4().hex}"

    def _written(self, rows: DataFrame, path: str, total: int, slots: list[str] | None = None) -> tuple[list[File], int]:
        """Write rows in the order of their keys, ``file_rows`` to a file; its files, and the largest ``ord``. With ``slots`` (bounds) no file spans two."""
        # Where files are small a task writes several, so that tasks follow the rows and not the files; no more than one of them is not full.
        parts, keys = max(1, -(-total // (self.file_rows * max(1, TASK_ROWS // self.file_rows)))), ["letter_id"]
        if slots is not None:
            rows, keys = rows.withColumn("_slot", slot_of(slots)("letter_id")), ["_slot", "letter_id"]
        rows = (rows.repartitionByRange(parts, *keys) if parts > 1 else rows.repartition(1)).sortWithinPartitions(*self.partition_by, *keys)
        by = (["_slot"] if slots is not None else []) + self.partition_by
        writer = rows.write.option("maxRecordsPerFile", self.file_rows).option("parquet.block.size", ROW_GROUP)
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{path}")
        there = self.spark.read.schema("ord bigint, letter_id string").option("recursiveFileLookup", True).parquet(f"{self.root}/{path}")
        found = there.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("letter_id").alias("a"), F.max("letter_id").alias("b"), F.count("*").alias("n"), F.max("ord").alias("o")).collect()  # a row a file
        files = [File(f"{path}/" + unquote(r.path).rpartition(f"/{path}/")[2], r.a, r.a, r.b, r.n) for r in found]
        return sorted(files, key=lambda f: (f.least, f.path)), max((r.o for r in found), default=-1)

    def _commit(self, head: dict, rows: DataFrame | None, gone: DataFrame, total: int) -> None:
        """Rows that count from now on, and the ids whose older rows don't; as a change, or folded into the base after ``CHAIN`` of them."""
        staged = self._staged()
        gone.select("letter_id").distinct().write.parquet(f"{self.root}/{staged}/gone")
        gone = self.spark.read.schema("letter_id string").parquet(f"{self.root}/{staged}/gone")
        base, slots, _ = self._slots(head, gone)
        touched = set(head["touched"]) | slots
        if base and len(head["chain"]) <= CHAIN:
            files, top = self._written(rows, f"{staged}/rows", total) if rows is not None else ([], -1)
            new = {"chain": head["chain"], "touched": sorted(touched)}
        else:
            held = [base[i] for i in sorted(touched)]
            whole = self._merged(head, held).join(gone, "letter_id", "left_anti")
            whole = whole.unionByName(rows) if rows is not None else whole
            total += sum(f.n for f in held) + sum(f.n for v in head["chain"][1:] for f in self._files(v))
            lows = [f.low for f in base]
            files, top = self._written(whole, f"{staged}/rows", total, lows if len(base) > 1 else None)
            # Of each slot the first new file takes over the bound; the others begin at their own least keys.
            seen: set[int] = set()
            for i, f in enumerate(files):
                slot = max(bisect_right(lows, f.least) - 1, 0)
                files[i] = f if slot in seen or not lows else f._replace(low=lows[slot])
                seen.add(slot)
            files = sorted([f for i, f in enumerate(base) if i not in touched] + files, key=lambda f: (f.low, f.least))
            new = {"chain": [], "touched": []}
        self._publish(head, staged, new | {"top": max(top, head["top"])}, files)

    def _publish(self, head: dict | None, staged: str, new: dict, files: list[File]) -> None:
        """Put a staged change in place, if ``head`` is still the state."""
        version = max(self._versions(), default=-1) + 1
        while True:  # a number is claimed by a file that only one writer can create
            try:
                self._fs.create(self._path(f"{self.root}/v{version}/CLAIM"), False).close()
                break
            except Exception as e:  # noqa: BLE001  what the JVM throws
                if "AlreadyExists" not in str(e):
                    raise
                version += 1
        began, seen = time.monotonic(), -1 if head is None else head["version"]
        for v in range(seen + 1, version):
            while self._exists(f"v{v}/CLAIM") and not self._exists(f"v{v}/HEADER") and time.monotonic() - began < LEASE:
                time.sleep(0.05)
            if self._exists(f"v{v}/HEADER"):
                self._delete(f"v{version}")
                self._delete(staged)
                raise Moved
        for part in ("rows", "gone"):
            if self._exists(f"{staged}/{part}"):
                self._rename(f"{staged}/{part}", f"v{version}/{part}")
        files = [f._replace(path=f"v{version}{f.path.removeprefix(staged)}") if f.path.startswith(f"{staged}/") else f for f in files]
        self._put(f"v{version}/FILES", [list(f) for f in files])
        uses = sorted({int(f.path.split("/")[0][1:]) for f in files} | {version} | {u for v in new["chain"] for u in self._get(f"v{v}/HEADER")["uses"]})
        self._put(f"v{version}/.HEADER", {"version": version, "embedding_model": self.model, "embedding_dimension": self.dimension, "uses": uses, "parent": seen} | new | {"chain": [*new["chain"], version]})
        if time.monotonic() - began > 2 * LEASE:
            raise TimeoutError(f"version {version} took too long to put in place")
        self._rename(f"v{version}/.HEADER", f"v{version}/HEADER")
        self._delete(staged)

    def _transact(self, make: Callable[[dict], tuple[DataFrame | None, DataFrame, int] | None]) -> None:
        """``make(head)`` gives rows, gone ids and the number of rows, or None if there is nothing to do; computed anew if the state moves meanwhile."""
        for _ in range(RETRIES):
            head = self._head()
            if (made := make(head)) is None:
                return
            try:
                return self._commit(head, *made)
            except Moved:
                continue
        raise ConcurrentChange(f"the state moved on {RETRIES} times")

    def changed_keys(self, version: int) -> DataFrame | None:
        """``letter_id`` of all letters that were changed on the way from ``version`` to the current one; None if a step of it was pruned."""
        out, at = self.spark.createDataFrame([], "letter_id string"), self.version()
        while at != version:
            if at < version or not self._exists(f"v{at}/HEADER"):
                return None
            out = out.unionByName(self._gone(at)) if self._exists(f"v{at}/gone") else out
            at = self._get(f"v{at}/HEADER")["parent"]
        return out

    def changed_since(self, version: int, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (``letter_id``) that versions after ``version`` have changed."""
        later = [v for v in self._versions() if v > version and self._exists(f"v{v}/HEADER") and self._exists(f"v{v}/gone")]
        none = self.spark.createDataFrame([], "letter_id string")
        return reduce(DataFrame.unionByName, map(self._gone, later), none).join(keys.select("letter_id"), "letter_id", "left_semi").distinct()

    def upsert(self, batch: DataFrame, since: int | None = None) -> None:
        """``batch`` has the store's columns but ``ord``, and ``pos``, its order. An empty batch leaves no new version.

        The batch is written down first, so that its vectors are computed once. Refused if one of its letters was changed after version ``since``.
        """
        written = f"{self._staged()}"
        batch.write.parquet(f"{self.root}/{written}/batch")
        batch = self.spark.read.schema(batch.schema).parquet(f"{self.root}/{written}/batch")
        try:
            if total := batch.count():

                def make(head: dict):
                    if since is not None and head["version"] > since and (lost := self.changed_since(since, batch).limit(1).collect()):
                        raise ConcurrentChange(f"{lost[0].letter_id} was changed after version {since}")
                    return changes(self.near(batch, head), batch, top=head["top"]), batch, total

                self._transact(make)
        finally:
            self._delete(written)

    def delete_ids(self, ids: Iterable[str]) -> None:
        keys = self.spark.createDataFrame([(i,) for i in ids], "letter_id string")
        self._remove(lambda head: self.near(keys, head).join(keys, "letter_id", "left_semi"))

    def delete_where(self, where: dict) -> None:
        self._remove(lambda head: self.rows().where(matches(where)))

    def keep_ids(self, ids: DataFrame) -> None:
        """Only letters in ``ids`` (``letter_id``) stay."""
        self._remove(lambda head: without_ids(self.rows(), ids))

    def _remove(self, rows: Callable[[dict], DataFrame]) -> None:
        held: list[DataFrame] = []

        def make(head: dict):
            found = rows(head).select("letter_id").persist()  # looked for once
            held.append(found)
            return (None, found, 0) if found.limit(1).count() else None  # nothing gone: no new version

        try:
            self._transact(make)
        finally:
            for found in held:
                found.unpersist()

    def count(self) -> int:
        return self.rows().count()

    def get(self, ids: Sequence[str]) -> DataFrame:
        keys = self.spark.createDataFrame(list(enumerate(ids)), "pos int, letter_id string")
        return lookup(self.near(keys), keys)

    def find(self, where: dict | None = None) -> DataFrame:
        return self.rows().where(matches(where)).orderBy("ord")

    def distinct(self, field: str) -> list[str]:
        return [r[0] for r in list_distinct(self.rows(), field).collect()]

    def query(self, vector: Sequence[float], k: int, where: dict | None = None) -> DataFrame:
        return cosine_query(self.rows(), vector, k, where)

    def prune(self, keep: int = 2) -> None:
        """Remove what neither the current version nor the ``keep - 1`` before it are made of, and what writers that died left."""
        heads = [self._get(f"v{v}/HEADER") for v in self._versions() if self._exists(f"v{v}/HEADER")]
        needed = {v for head in heads[:keep] for v in head["uses"]}
        for v in self._versions():
            if v not in needed and v < heads[0]["version"]:
                self._delete(f"v{v}")
        for f in self._fs.listStatus(self._path(self.root)):
            if (name := f.getPath().getName()).startswith("w-") and time.time() - f.getModificationTime() / 1000 > STALE:
                self._delete(name)
