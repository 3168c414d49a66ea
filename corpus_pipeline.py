"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that the one before it kept, whole, and its decisions take effect: rejected documents go, repeated
lines go, one document of each near-duplicate group stays (the least id), contaminated documents go, and the rest is tokenised. All
stages but the last return the columns of ``documents``, and any others that came with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from letterloom.llm._session import checkpoints
from letterloom.llm._packs import settled
from letterloom.ship import ship


def private(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    name, held = "row_key", {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def wide_key() -> Column:
    """128 bits, where the key alone names a text."""
    return F.md5(F.col("text").cast("string"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Learns from labels outside the held-out fold only."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.fold_of(5) != 0)
    return toxicity.without_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 signs that stand in three documents stay in one; ``n_chars`` follows the text."""
    kept = line_dedup.line_dedup(docs, carry=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, copies among them, one row stays: that with the least id, one without an id only if none has
    one, and of rows that share the least id the first. What stays has a key for each document, so it is never broadcast.

    Rows are told apart by their places, which do not change between readings of a table; each is judged by its own text, whatever its id.
    """
    key, docs = private(docs), settled(docs)
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    linked = jaccard_join.jaccard_join(keyed.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id")), carry=("id",))
    first = F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))
    stay = linked.groupBy("component_id").agg(first.alias("first")).select(F.col("first.doc_id").alias(key))
    return keyed.join(stay.hint("merge"), key, "left_semi").select(docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, each judged by its own text, whatever its id: null and repeated ones are no exception."""
    key = private(docs)
    keyed = docs.withColumn(key, wide_key())
    told = decontaminate.contamination(keyed.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    gone = told.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone.hint("merge"), key, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids (little-endian 32-bit) and digests of them and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.bpe_round_trip(docs, ranks, 2 << 20)  # smaller packs: workers also hold what earlier stages left
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", contaminated), ("byte-level BPE", tokens)]
#: The learnt score and the tokenizer are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    checkpoints(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
