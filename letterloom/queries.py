"""Every operator as a query over the test tables, and the same in SQL.

``letters`` is ``documents`` with ``source`` as department and ``lang`` as letter type; vectors come from ``embeddings`` by id. Operators on Hindi
letters have inline rows beside those of the tables, which hold none. All queries read their whole tables.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import plausibility as pl
from .functions import text as tx
from .operators import batch, embed, export, fonts, generate, index, long_files, metadata, retrieve, segment, store
from .plans import ingest
from .sources import files, state
from .spread import spread

QUERY = "the and hein"
TERMS = ["the", "and", "hein"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark) -> str:
    """A folder that executors can read: that of the checkpoints, or where none is set, in local mode only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="letterloom-sample-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def letters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("letter_id"), F.col("source").alias("department"), F.col("lang").alias("letter_type"), "text")


def letter_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("letter_id"), "embedding")


def with_vectors(spark, sf_dir):
    """All letters; one without a vector has the empty one, whose cosine is 0."""
    return letters(spark, sf_dir).join(letter_vectors(spark, sf_dir), "letter_id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))


def in_two_departments(rows):
    """Nine in ten letters in one department, so that a vote can be clear."""
    return rows.withColumn("department", F.when(F.col("letter_id") % 10 < 9, "main").otherwise("other"))


TWO = "CASE WHEN doc_id % 10 < 9 THEN 'main' ELSE 'other' END"


def first_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first().embedding)


LETTERS = "SELECT doc_id AS letter_id, source AS department, lang AS letter_type, text FROM documents"


# Filters, lookups, distinct values.
@query(f"SELECT letter_id, department FROM ({LETTERS}) WHERE department = 'src3' AND letter_type = 'en'")
def filter_eq(spark, sf_dir):
    return letters(spark, sf_dir).where(store.matches(store.build_filter("src3", "en"))).select("letter_id", "department")


@query(f"SELECT letter_type, count(*) AS n FROM ({LETTERS}) GROUP BY ALL")
def filter_empty(spark, sf_dir):
    return letters(spark, sf_dir).where(store.matches(store.build_filter("", None))).groupBy("letter_type").agg(F.count("*").alias("n"))


@query(f"SELECT pos, letter_id, department FROM (VALUES (0, 5), (1, 3), (2, 5), (3, -7)) v(pos, id) JOIN ({LETTERS}) ON letter_id = id")
def get_by_ids(spark, sf_dir):
    ids = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, -7)], "pos int, letter_id long")
    return store.lookup(letters(spark, sf_dir), ids).select("pos", "letter_id", "department")


@query("SELECT count(*) AS n FROM documents")
def count_store(spark, sf_dir):
    return letters(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source AS department FROM documents WHERE source <> '' ORDER BY 1")
def list_distinct(spark, sf_dir):
    return store.list_distinct(letters(spark, sf_dir), "department")


# Lines and segments.
WS = r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STRIP = rf"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
SPLIT = f"SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split_regex(text, '{NL}') AS ls FROM documents WHERE text IS NOT NULL)"
CLEAN = STRIP % r"regexp_replace(regexp_replace(line, '[ \t]+$', ''), '[ \t]{2,}', ' ', 'g')"
LINES = f"SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no FROM ({SPLIT}) WHERE {STRIP % 'line'} <> ''"


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.posexplode(tx.text_lines("text")).alias("line_no", "text"))


def document_files(spark, sf_dir):
    lines = F.transform(tx.text_lines("text"), lambda x: F.struct(x.alias("text")))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("source_file"), lines.alias("lines"))


@query(f"SELECT doc_id, count(*) AS n_lines, md5(string_agg(c, chr(10) ORDER BY i)) AS cleaned FROM (SELECT doc_id, i, {CLEAN} AS c FROM ({SPLIT}) WHERE {STRIP % 'line'} <> '') GROUP BY doc_id")
def split_clean_lines(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.clean_lines(tx.text_lines("text")).alias("x")).where(F.size("x") > 0)
    return d.select("doc_id", F.size("x").cast("long").alias("n_lines"), F.md5(F.array_join("x", "\n")).alias("cleaned"))


FREQUENCY = f"SELECT doc_id, {STRIP % 'line'} AS l, count(*) AS n, min(line_no) AS first_line_no FROM ({LINES}) WHERE length({STRIP % 'line'}) > 4 GROUP BY ALL"


@query(f"SELECT doc_id, md5(l) AS line, n, first_line_no FROM ({FREQUENCY})")
def line_freq(spark, sf_dir):
    f = segment.line_frequency(document_lines(spark, sf_dir))
    return f.select(F.col("source_file").alias("doc_id"), F.md5("line").alias("line"), "n", F.col("first_line_no").cast("long").alias("first_line_no"))


def anchors_sql(required=()):
    """With lines that must hold all words of ``required``."""
    return ANCHORS.replace("WHERE n >= 3", "WHERE n >= 3" + "".join(f" AND contains(l, '{w}')" for w in required))


ANCHORS = f"""
f AS (SELECT * FROM ({FREQUENCY}) WHERE n >= 3), best AS (SELECT doc_id, l FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_line_no) = 1),
ln AS MATERIALIZED ({LINES}),
a AS (SELECT ln.doc_id, line_no, row_number() OVER (PARTITION BY ln.doc_id ORDER BY line_no) - 1 AS anchor_no FROM ln JOIN best ON best.doc_id = ln.doc_id AND {STRIP % 'ln.line'} = best.l)"""
SEGMENTS = f"""{ANCHORS},
n AS (SELECT doc_id, max(line_no) + 1 AS n FROM ln GROUP BY doc_id),
s AS (SELECT n.doc_id, coalesce(anchor_no, 0) AS segment_index, CASE WHEN anchor_no IS NULL THEN 0 ELSE greatest(line_no - 2, anchor_no) END AS start_line, n.n, anchor_no IS NULL AS gated FROM n LEFT JOIN a ON a.doc_id = n.doc_id),
g AS (SELECT doc_id, segment_index, start_line, coalesce(lead(start_line) OVER (PARTITION BY doc_id ORDER BY segment_index), n) - 1 AS end_line, gated FROM s)"""


@query(f"WITH {ANCHORS} SELECT doc_id, line_no, anchor_no FROM a")
def anchor_lines(spark, sf_dir):
    a = segment.marked(document_files(spark, sf_dir), required=()).select(F.col("source_file").alias("doc_id"), F.posexplode("anchor_lines").alias("anchor_no", "line_no"))
    return a.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("anchor_no").cast("long").alias("anchor_no"))


@query(f"WITH {anchors_sql(('e', 'n'))} SELECT a.doc_id, line_no, anchor_no, md5(best.l) AS anchor FROM a JOIN best ON best.doc_id = a.doc_id")
def required_anchors(spark, sf_dir):
    """A header has to hold all the words that it must hold; of two candidates the more frequent counts, then the earlier."""
    a = segment.marked(document_files(spark, sf_dir), required=("e", "n"))
    a = a.select(F.col("source_file").alias("doc_id"), F.posexplode("anchor_lines").alias("anchor_no", "line_no"), F.md5("anchor_text").alias("anchor"))
    return a.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("anchor_no").cast("long").alias("anchor_no"), "anchor")


@query(f"WITH {SEGMENTS} SELECT doc_id, segment_index::INT AS segment_index, start_line::INT AS start_line, end_line::INT AS end_line, gated FROM g")
def segments(spark, sf_dir):
    return segment.cut(document_files(spark, sf_dir), required=()).select(F.col("source_file").alias("doc_id"), "segment_index", "start_line", "end_line", "gated")


@query(f"WITH {SEGMENTS} SELECT g.doc_id, segment_index::INT AS segment_index, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM g JOIN ln ON ln.doc_id = g.doc_id AND line_no BETWEEN start_line AND end_line GROUP BY ALL")
def segment_text(spark, sf_dir):
    s = segment.cut(document_files(spark, sf_dir), required=())
    return s.select(F.col("source_file").alias("doc_id"), "segment_index", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("body"))


# All documents of a source as one file, whose lines are rows.
LONG = SEGMENTS.replace(LINES, f"SELECT coalesce(source, '') AS doc_id, line, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY l.doc_id, line_no) - 1 AS line_no FROM ({LINES}) l JOIN documents d ON d.doc_id = l.doc_id")


def long_lines(spark, sf_dir):
    """``source_file, line_no, text``: numbered by a prefix scan over the documents' numbers of lines, as a source may hold a third of all rows."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source_file"), "doc_id", tx.text_lines("text").alias("x")).withColumn("n", F.greatest(F.size("x"), F.lit(0)))
    d = long_files.running_sum(d, ["source_file"], "doc_id", "n", "upto", block=4096)
    return d.select("source_file", (F.col("upto") - F.col("n")).alias("before"), F.posexplode("x").alias("i", "text")).select("source_file", (F.col("before") + F.col("i")).cast("int").alias("line_no"), "text")


@query(f"WITH {LONG} SELECT doc_id AS source_file, segment_index::INT AS segment_index, start_line::INT AS start_line, end_line::INT AS end_line, gated FROM g")
def long_file_segments(spark, sf_dir):
    return long_files.segments(long_lines(spark, sf_dir), required=()).drop("anchor_text")


@query(f"WITH {LONG} SELECT g.doc_id AS source_file, segment_index::INT AS segment_index, count(*) AS n_lines, sum(length(line))::BIGINT AS n_signs, max(md5(line)) AS greatest FROM g JOIN ln ON ln.doc_id = g.doc_id AND line_no BETWEEN start_line AND end_line GROUP BY ALL")
def long_file_lines(spark, sf_dir):
    lines = long_lines(spark, sf_dir)
    found = long_files.assigned(lines, long_files.segments(lines, required=()))
    return found.groupBy("source_file", "segment_index").agg(F.count("*").alias("n_lines"), F.sum(F.length("text").cast("long")).alias("n_signs"), F.max(F.md5("text")).alias("greatest"))


# Terms and BM25.
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, len({TOKENS}) AS n_terms, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def candidates(where="true", vectors=True, department="source"):
    join = "LEFT JOIN embeddings ON vec_id = doc_id" if vectors else ""
    return f"c AS MATERIALIZED (SELECT doc_id AS letter_id, {department} AS department, lang AS letter_type, text, {'embedding, ' if vectors else ''}{TOKENS} AS toks FROM documents {join} WHERE {where})"


STATS = """st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM c),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM c) GROUP BY term),
idf AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
w AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf) ELSE raw END AS idf FROM idf)"""


def bm25_sql():
    part = "coalesce((SELECT idf FROM w WHERE term = '{t}') * len(list_filter(toks, lambda x: x = '{t}'))::DOUBLE * 2.5 / (len(list_filter(toks, lambda x: x = '{t}'))::DOUBLE + 1.5 * (0.25 + 0.75 * len(toks) / (SELECT a FROM st))), 0)"
    return "0.0::DOUBLE + " + " + ".join(part.format(t=t) for t in TERMS)


@query(f"WITH {candidates("lang = 'en'", False)}, {STATS} SELECT term, df, round(idf, 6) AS idf FROM w")
def bm25_stats(spark, sf_dir):
    t = retrieve.with_tokens(letters(spark, sf_dir).where(store.matches({"letter_type": "en"})))
    df = retrieve.document_frequency(t)
    idf = df.withColumn("raw", retrieve.raw_idf(F.lit(retrieve.corpus_stats(t).first().n_docs), F.col("df")))
    mean = idf.agg(F.avg("raw")).first()[0]
    return idf.select("term", "df", F.round(F.when(F.col("raw") < 0, retrieve.EPSILON * mean).otherwise(F.col("raw")), 6).alias("idf"))


@query(f"WITH {candidates("lang = 'en'", False)}, {STATS}, s AS (SELECT letter_id, {bm25_sql()} AS b FROM c) SELECT letter_id, round(b, 6) AS score FROM s ORDER BY b DESC, letter_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    t = retrieve.with_tokens(letters(spark, sf_dir).where(store.matches({"letter_type": "en"})))
    return retrieve.top(retrieve.bm25(t, TERMS), "bm25", 20).select("letter_id", F.round("bm25", 6).alias("score"))


@query(f"WITH {candidates('true', False)}, {STATS}, s AS (SELECT letter_id, {bm25_sql()} AS b FROM c WHERE list_has_any(toks, {TERMS})) SELECT letter_id, round(b, 5) AS score FROM s")
def bm25_postings(spark, sf_dir):
    t = retrieve.with_tokens(letters(spark, sf_dir)).select("letter_id", "tokens", "n_terms")
    return retrieve.bm25_from_postings(retrieve.postings(t), t.select("letter_id", "n_terms"), TERMS).select("letter_id", F.round("bm25", 5).alias("score"))


# Vectors.
COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "vec_id", "label", "embedding")


@query(f"SELECT vec_id, round(1 - {COSINE}, 6) AS distance FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    return store.cosine_query(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(1 - {COSINE}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def cosine_filtered(spark, sf_dir):
    return store.cosine_query(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, {"label": 3}).select("vec_id", F.round("distance", 6).alias("distance"))


@query(rf"""WITH t AS (SELECT item_id, sha256(unnest({TOKENS})) AS h FROM benchmark),
p AS (SELECT item_id, ('0x' || h[1:8])::BIGINT % 64 AS i, CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM t),
v AS (SELECT item_id, i, sum(s) AS x FROM p GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY item_id)
SELECT b.item_id, g.i::INT AS place, round(coalesce(x / nullif(n, 0), 0), 6) + 0.0 AS value FROM benchmark b CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS i) g LEFT JOIN v ON v.item_id = b.item_id AND v.i = g.i LEFT JOIN n ON n.item_id = b.item_id""")
def hash_embedding(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(embed.hash_embedding("text")).alias("place", "v"))
    return b.select("item_id", "place", (F.round("v", 6) + 0.0).alias("value"))


# Hybrid retrieval.
def hybrid_cte(where="true", department="source"):
    return f"""{candidates(where, department=department)}, {STATS}, s AS MATERIALIZED (SELECT letter_id, department, letter_type, text, {bm25_sql()} AS b, coalesce({COSINE}, 0) AS v FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY b DESC, letter_id) AS r1, row_number() OVER (ORDER BY v DESC, letter_id) AS r2 FROM s),
h AS (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS f, row_number() OVER (ORDER BY 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) DESC, r1) AS rank FROM r)"""


HITS = "SELECT rank::INT AS rank, letter_id, department, r1::INT AS bm25_rank, r2::INT AS semantic_rank, round(f, 8) AS fused_score FROM h WHERE rank <= {}"


def shown(hits):
    return hits.select("rank", "letter_id", "department", "bm25_rank", "semantic_rank", F.round("fused_score", 8).alias("fused_score"))


# A store over the letters and what follows it from version to version.
def stored(spark, sf_dir, file_rows=200):
    """The letters in a store, ids as text of one width: written in two changes, the second of which an index has to catch up with."""
    held = store.Store(spark, f"{shared(spark)}/letterloom-store-{uuid.uuid4().hex}", "given", 64, file_rows=file_rows)
    rows = with_vectors(spark, sf_dir).select(
        F.col("ord").alias("pos"), F.lpad(F.col("letter_id").cast("string"), 12, "0").alias("letter_id"), F.col("text").alias("document"), "department", F.lit(None).cast("string").alias("office"), "letter_type",
        F.lit(None).cast("string").alias("subject"), F.concat(F.lit("f"), F.floor(F.col("ord") / 50)).alias("source_file"), F.lit(False).alias("needs_review"), F.create_map().cast("map<string,string>").alias("extra"), "embedding",
    )
    cut = (rows.agg(F.max("pos")).first()[0] or 0) * 9 // 10
    held.upsert(rows.where(F.col("pos") <= cut))
    return held, lambda: held.upsert(rows.where(F.col("pos") > cut))


@query("""SELECT doc_id AS letter_id, source AS department, md5(CASE WHEN doc_id BETWEEN 100 AND 109 THEN 'changed: ' || text ELSE text END) AS body FROM documents WHERE doc_id % 50 <> 7
UNION ALL SELECT max(doc_id) + 1, 'new', md5('added') FROM documents""")
def store_changes(spark, sf_dir):
    """A store in slots; the second change reads and touches only the files that its keys fall into."""
    held, rest = stored(spark, sf_dir)
    rest()
    rows = held.rows()
    some = rows.where(F.col("letter_id").between("000000000100", "000000000109")).withColumn("document", F.concat(F.lit("changed: "), F.col("document")))
    last = rows.where(F.col("letter_id") == rows.agg(F.max("letter_id")).first()[0]).withColumn("letter_id", F.lpad((F.col("letter_id").cast("long") + 1).cast("string"), 12, "0")).withColumn("document", F.lit("added")).withColumn("department", F.lit("new"))
    held.upsert(some.unionByName(last).withColumn("pos", F.col("ord")).drop("ord"))
    held.keep_ids(held.rows().where((F.col("letter_id").cast("long") % 50 != 7) | (F.col("document") == "added")).select("letter_id"))
    return held.rows().select(F.col("letter_id").cast("long").alias("letter_id"), "department", F.md5("document").alias("body"))


@query(f"WITH {candidates("lang = 'en'", False)}, {STATS}, s AS (SELECT letter_id, {bm25_sql()} AS b FROM c) SELECT letter_id, round(b, 6) AS score FROM s ORDER BY b DESC, letter_id LIMIT 20")
def term_index_topk(spark, sf_dir):
    """As bm25_topk, from blocks of the query's terms, half of the letters indexed before the other half came."""
    held, rest = stored(spark, sf_dir, 100_000)
    terms = index.TermIndex(held, f"{held.root}/terms")
    terms.update()
    rest()
    best, _ = terms.top(TERMS, 20, {"letter_type": "en"})
    return best.join(held.rows().select("ord", "letter_id"), "ord").select(F.col("letter_id").cast("long").alias("letter_id"), F.round("bm25", 6).alias("score"))


@query(f"SELECT doc_id AS letter_id, round(1 - coalesce({COSINE}, 0), 6) AS distance FROM documents LEFT JOIN embeddings ON vec_id = doc_id ORDER BY coalesce({COSINE}, 0) DESC, doc_id LIMIT 10")
def ball_index_topk(spark, sf_dir):
    """The nearest letters by balls of vectors and the triangle inequality."""
    d = letters(spark, sf_dir)
    held, rest = stored(spark, sf_dir, 100_000)
    balls = index.BallIndex(held, f"{held.root}/balls")
    balls.update()
    rest()
    best, _ = balls.query(first_vector(spark, sf_dir), 10)
    return d.select("letter_id").join(best.select(F.col("letter_id").cast("long").alias("letter_id"), F.round("distance", 6).alias("distance")), "letter_id")


@query("""SELECT d.doc_id AS source_file, CASE WHEN d.doc_id % 10 = 0 THEN 'added' WHEN d.doc_id % 10 = 1 THEN 'gone' WHEN d.doc_id % 7 = 0 THEN 'changed' WHEN d.doc_id % 7 = 1 THEN 'touched' ELSE 'same' END AS status FROM documents d""")
def file_states(spark, sf_dir):
    """Documents as files: what was added, changed, touched, left alone and removed since an earlier listing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    time = lambda n: F.timestamp_seconds(F.lit(n))
    now = d.where("source_file % 10 <> 1").withColumn("modified", F.when(F.col("source_file") % 7 < 2, time(2)).otherwise(time(1)))
    before = d.where("source_file % 10 <> 0").select("source_file", "length", time(1).alias("modified"), F.sha2(F.when(F.col("source_file") % 7 == 0, F.lit(b"other")).otherwise(F.col("content")), 256).alias("digest"))
    read = lambda names: d.where(F.col("source_file").isin(names)).select("source_file", "content")
    return state.settled(state.difference(now, before), read).select("source_file", "status")


# Each document whose id is a multiple of 100 asks with its first words and its vector.
ASKED = f"SELECT doc_id AS qid, array_to_string({TOKENS}[1:3], ' ') AS query, {TOKENS}[1:3] AS ts, embedding AS qv FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0"


@query(f"""WITH {candidates()}, {STATS}, q AS MATERIALIZED ({ASKED}), qt AS (SELECT qid, unnest(ts) AS t FROM q),
tf AS MATERIALIZED (SELECT letter_id, t, count(*)::DOUBLE AS tf FROM (SELECT letter_id, unnest(toks) AS t FROM c) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
b AS (SELECT qid, letter_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / (SELECT a FROM st)))) AS b FROM qt JOIN tf USING (t) JOIN w ON w.term = t JOIN c USING (letter_id) GROUP BY ALL),
s AS MATERIALIZED (SELECT q.qid, c.letter_id, round(coalesce(b.b, 0), 9) AS b, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 0), 9) AS v FROM q CROSS JOIN c LEFT JOIN b ON b.qid = q.qid AND b.letter_id = c.letter_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY b DESC, letter_id) AS r1, row_number() OVER (PARTITION BY qid ORDER BY v DESC, letter_id) AS r2 FROM s),
h AS (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS f, row_number() OVER (PARTITION BY qid ORDER BY 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) DESC, r1) AS rank FROM r)
SELECT qid, rank::INT AS rank, letter_id, r1::INT AS bm25_rank, r2::INT AS semantic_rank, round(f, 8) AS fused_score FROM h WHERE rank <= 5""")
def batch_hybrid(spark, sf_dir):
    """Hybrid retrieval for a table of queries at once."""
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(tx.tokenize("text"), 1, 3), " ").alias("query"))
    asked = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), "qid")
    done = batch.retrieve_many(with_vectors(spark, sf_dir), asked, 5)
    return done.select("qid", "rank", "letter_id", "bm25_rank", "semantic_rank", F.round("fused_score", 8).alias("fused_score"))


@query("""SELECT doc_id AS letter_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused_score FROM (SELECT doc_id, doc_id + 1 AS rank FROM documents UNION ALL SELECT doc_id, 2 * doc_id - quality + 2 FROM labels) GROUP BY doc_id""")
def rrf_fuse(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("letter_id"), (F.col("doc_id") + 1).alias("rank"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("letter_id"), (2 * F.col("doc_id") - F.col("quality") + 2).alias("rank"))
    return retrieve.reciprocal_ranks(a.unionAll(b)).select("letter_id", F.round("fused_score", 8).alias("fused_score"))


@query(f"WITH {hybrid_cte()} {HITS.format(10)}")
def hybrid_topk(spark, sf_dir):
    return shown(retrieve.retrieve(letters(spark, sf_dir), QUERY, first_vector(spark, sf_dir), 10, vectors=letter_vectors(spark, sf_dir)))


@query(f"WITH {hybrid_cte("lang = 'fr'")} {HITS.format(10)}")
def hybrid_filtered(spark, sf_dir):
    return shown(retrieve.retrieve(letters(spark, sf_dir), QUERY, first_vector(spark, sf_dir), 10, {"letter_type": "fr"}, vectors=letter_vectors(spark, sf_dir)))


VOTE = "v AS (SELECT department, count(*) AS n, min(rank) AS r FROM h WHERE rank <= 5 AND department <> '' GROUP BY department), best AS (SELECT department, n, n / (SELECT sum(n) FROM v) AS share FROM v ORDER BY n DESC, r LIMIT 1)"


@query(f"WITH {hybrid_cte()}, {VOTE} SELECT CASE WHEN share >= 0.6 THEN department END AS department, n, share::DOUBLE AS share FROM best")
def auto_department(spark, sf_dir):
    return retrieve.vote(retrieve.retrieve(letters(spark, sf_dir), QUERY, first_vector(spark, sf_dir), 5, vectors=letter_vectors(spark, sf_dir)))


@query(f"WITH {hybrid_cte("lang = 'en'")} {HITS.format(5)}")
def two_stage(spark, sf_dir):
    """No department holds three of five hits here, so only the letter type filters the second stage."""
    hits, _, _ = retrieve.two_stage(letters(spark, sf_dir), QUERY, first_vector(spark, sf_dir), 5, None, "en", vectors=letter_vectors(spark, sf_dir))
    return shown(hits)


@query(f"WITH {hybrid_cte(department=TWO)}, {VOTE} SELECT CASE WHEN share >= 0.6 THEN department END AS department, n, share::DOUBLE AS share FROM best")
def auto_department_found(spark, sf_dir):
    return retrieve.vote(retrieve.retrieve(in_two_departments(letters(spark, sf_dir)), QUERY, first_vector(spark, sf_dir), 5, vectors=letter_vectors(spark, sf_dir)))


@query(f"WITH {hybrid_cte(f"lang = 'en' AND {TWO} = (WITH {hybrid_cte(department=TWO)}, {VOTE} SELECT department FROM best WHERE share >= 0.6)", TWO)} {HITS.format(5)}")
def two_stage_found(spark, sf_dir):
    """The vote is clear, so the second stage is filtered by department and type."""
    hits, _, _ = retrieve.two_stage(in_two_departments(letters(spark, sf_dir)), QUERY, first_vector(spark, sf_dir), 5, None, "en", vectors=letter_vectors(spark, sf_dir))
    return shown(hits)


# Store changes.
@query("""WITH b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'kept' ELSE 'revised' END AS text FROM labels), n AS (SELECT conv_id + 1000000000 AS doc_id, max(text) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id AS letter_id, md5(text) AS body FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, md5(text) FROM b UNION ALL SELECT doc_id, md5(text) FROM n""")
def upsert(spark, sf_dir):
    base = letters(spark, sf_dir).select("ord", "letter_id", "text")
    revised = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("letter_id"), F.when(F.col("quality") == 1, "kept").otherwise("revised").alias("text"), F.col("doc_id").alias("pos"))
    older = revised.select("letter_id", F.lit("superseded in the batch").alias("text"), (F.col("pos") - 1_000_000_000).alias("pos"))
    new = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("text").alias("text")).select((F.col("conv_id") + 1_000_000_000).alias("letter_id"), "text", F.col("conv_id").alias("pos"))
    return store.upserted(base, revised.unionByName(older).unionByName(new)).select("letter_id", F.md5("text").alias("body"))


@query("SELECT doc_id AS letter_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, sf_dir):
    return store.without_ids(letters(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("letter_id"))).select("letter_id")


@query("SELECT doc_id AS letter_id FROM documents WHERE NOT coalesce(source = 'src3' AND lang = 'en', false)")
def delete_by_filter(spark, sf_dir):
    return store.without_matches(letters(spark, sf_dir), {"department": "src3", "letter_type": "en"}).select("letter_id")


# Rollups, review, corrections.
def reviewed(spark, sf_dir):
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("letter_id"), F.col("quality").cast("double").alias("min_line_plausibility"))
    rows = letters(spark, sf_dir).join(q, "letter_id", "left").withColumn("needs_review", pl.needs_review(F.coalesce("min_line_plausibility", F.lit(1.0))))
    return rows.withColumn("source_file", F.col("department")).withColumn("segment_index", F.col("letter_id")).withColumn("office", F.col("letter_type"))


REVIEW = "SELECT d.doc_id AS letter_id, source AS department, lang AS letter_type, coalesce(quality, 1) < 0.6 AS needs_review FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query(f"SELECT department AS source_file, count(*) AS segment_count, count(*) FILTER (needs_review) AS needs_review_count, arg_min(department, letter_id) AS department, arg_min(letter_type, letter_id) AS office FROM ({REVIEW}) GROUP BY department")
def doc_rollup(spark, sf_dir):
    return ingest.document_rollup(reviewed(spark, sf_dir))


@query(f"SELECT count(*) AS letters_found, count(DISTINCT letter_id) AS letters_indexed, count(*) FILTER (needs_review) AS needs_review FROM ({REVIEW})")
def ingest_summary(spark, sf_dir):
    return ingest.summary(reviewed(spark, sf_dir))


@query(f"SELECT letter_id FROM ({REVIEW}) WHERE needs_review")
def needs_review(spark, sf_dir):
    return reviewed(spark, sf_dir).where("needs_review").select("letter_id")


@query("SELECT d.doc_id AS letter_id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, source) AS department, coalesce(CASE WHEN quality = 0 THEN 'junk' END, lang) AS letter_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def override_merge(spark, sf_dir):
    o = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("letter_id"), F.when(F.col("toxic") == 1, "toxic").alias("department"), F.when(F.col("quality") == 0, "junk").alias("letter_type"))
    return metadata.with_overrides(letters(spark, sf_dir), o).select("letter_id", "department", "letter_type")


def open_maps(spark, sf_dir):
    """Each document's automatic fields and, from its label, corrections, some of them null or new."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.when(F.col("toxic") == 1, "toxic").alias("source"))
    d = table(spark, sf_dir, "documents").join(marks.select("doc_id", F.create_map(F.lit("source"), "source", F.lit("quality"), "quality").alias("override")), "doc_id", "left")
    return d.select("doc_id", F.create_map(F.lit("source"), "source", F.lit("lang"), F.nullif("lang", F.lit("es"))).alias("auto"), "override")


AUTO = "SELECT d.doc_id, k, CASE k WHEN 'source' THEN source ELSE nullif(lang, 'es') END AS v FROM documents d, (VALUES ('source'), ('lang')) t(k)"
NEW = "SELECT doc_id, k, CASE k WHEN 'quality' THEN quality::VARCHAR WHEN 'source' THEN CASE WHEN toxic = 1 THEN 'toxic' END END AS v FROM labels, (VALUES ('source'), ('quality')) t(k)"


@query(f"SELECT doc_id, k, coalesce(n.v, a.v) AS v FROM ({AUTO}) a FULL JOIN (SELECT * FROM ({NEW}) WHERE v IS NOT NULL) n USING (doc_id, k)")
def override_map(spark, sf_dir):
    return open_maps(spark, sf_dir).select("doc_id", F.explode(metadata.merged_map("auto", "override")).alias("k", "v"))


@query(f"SELECT doc_id, k, v FROM ({AUTO}) WHERE v IS NOT NULL")
def scalar_metadata(spark, sf_dir):
    return open_maps(spark, sf_dir).select("doc_id", F.explode(metadata.scalar_metadata("auto")).alias("k", "v"))


@query("SELECT doc_id AS letter_id, coalesce(l.quality, 0)::BOOLEAN AS needs_review, coalesce(nullif(source, 'src0'), 'unknown') AS department FROM documents LEFT JOIN labels l USING (doc_id)")
def defaults(spark, sf_dir):
    rows = letters(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("letter_id"), "quality"), "letter_id", "left")
    return rows.select("letter_id", F.coalesce(F.col("quality").cast("boolean"), F.lit(False)).alias("needs_review"), F.coalesce(F.nullif("department", F.lit("src0")), F.lit("unknown")).alias("department"))


# Order-dependent operators.
@query("""WITH x AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, (sum(c) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS group_no FROM x) SELECT conv_id, group_no, role, count(*) AS n, md5(string_agg(text, '' ORDER BY turn)) AS body FROM g GROUP BY ALL""")
def run_grouping(spark, sf_dir):
    rows = fonts.islands(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "group_no", "role").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("body"))


@query("""WITH x AS (SELECT conv_id, turn, trim(text) AS t, role = 'user' AS stop FROM conversations), l AS (SELECT conv_id, turn, lead(t, 1) OVER w AS a, lead(t, 2) OVER w AS b, lead(t, 3) OVER w AS c,
lead(stop, 1) OVER w AS sa, lead(stop, 2) OVER w AS sb, lead(stop, 3) OVER w AS sc FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(CASE WHEN coalesce(sa, true) THEN NULL WHEN coalesce(sb, true) THEN a WHEN coalesce(sc, true) THEN a || ' ' || b ELSE a || ' ' || b || ' ' || c END) AS ahead FROM l""")
def lookahead(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    lines = F.transform("x", lambda p: F.when(p["role"] == "user", F.lit("")).otherwise(p["text"]))
    c = c.select("conv_id", "x", lines.alias("lines"))
    ahead = F.transform("x", lambda p, i: F.struct(p["turn"].alias("turn"), metadata.following(F.col("lines"), i, tx.is_blank).alias("a")))
    return c.select("conv_id", F.explode(ahead).alias("p")).select("conv_id", "p.turn", F.md5("p.a").alias("ahead"))


# Projections.
@query("SELECT doc_id, printf('doc%d__seg%03d', doc_id, n_chars % 2000) AS letter_id FROM documents")
def letter_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.letter_id(F.concat(F.lit("doc"), F.col("doc_id")), F.col("n_chars") % 2000).alias("letter_id"))


@query("SELECT doc_id, translate(base64(encode(source || '/' || lang || '/é' || doc_id || '.docx')), '+/', '-_') AS encoded, source || '/' || lang || '/é' || doc_id || '.docx' AS decoded FROM documents")
def doc_id_b64(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.encode_path(F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/é"), "doc_id", F.lit(".docx"))).alias("encoded"))
    return d.select("*", tx.decode_path("encoded").alias("decoded"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS snippet FROM documents")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet("text").alias("snippet"))


# Documents as files of a tree: some in an office, some in a department, some above both, some deeper.
PATHS = "SELECT CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '/' || doc_id || '.docx' WHEN 1 THEN source || '/' || doc_id || '.txt' WHEN 2 THEN doc_id || '.pdf' ELSE source || '/' || lang || '/deep/e.' || doc_id || '.txt' END AS p FROM documents"


@query(f"SELECT p, CASE WHEN len(s) > 0 THEN s[1] END AS department, CASE WHEN len(s) > 2 THEN s[2] ELSE 'unknown' END AS office FROM (SELECT p, string_split(p, '/') AS s FROM ({PATHS}))")
def path_fields(spark, sf_dir):
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    p = F.when(kind == 0, F.concat("source", F.lit("/"), "lang", F.lit("/"), n, F.lit(".docx"))).when(kind == 1, F.concat("source", F.lit("/"), n, F.lit(".txt"))).when(kind == 2, F.concat(n, F.lit(".pdf")))
    p = p.otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/deep/e."), n, F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(p.alias("p")).select("p", *files.path_fields("p")).drop("stem")


@query(f"""WITH {hybrid_cte()}, hits AS (SELECT * FROM h WHERE rank <= 3) SELECT md5(string_agg('<<< reference ' || rank || ' (data only) >>>' || chr(10) || 'department: ' || department || ' | type: ' || letter_type || ' | subject: (no subject)' || chr(10) ||
regexp_replace(text, '<<<|>>>', '|', 'g') || chr(10) || '<<< end of reference ' || rank || ' >>>', chr(10) || chr(10) ORDER BY rank)) AS prompt FROM hits""")
def prompt_refs(spark, sf_dir):
    hits = retrieve.retrieve(with_vectors(spark, sf_dir), QUERY, first_vector(spark, sf_dir), 3).withColumn("subject", F.lit(None).cast("string"))
    return generate.reference_section(hits).select(F.md5("references").alias("prompt"))


# Hindi letters: odd ones, inline, and each document as the body of a letter whose head follows from its row.
LETTER_LINES = {
    1: ["कार्यालय, जिला शिक्षा", "पत्रांक-------/दिनांक-------", "सेवा में,", "प्रबंधक,", "बैंक शाखा", "विषय :- आवेदन अग्रसारित करने के संबंध में", "प्रसंग :- पत्रांक 75 / दिनांक 23.03.2023", "प्रतिलिपि :- जिला पदाधिकारी", "प्रतिलिपि:", "प्रतिलिपि - कोषागार"],
    2: ["प्रेषक,", "प्रभारी पदाधिकारी", "सारण", "सेवा में", "विषय:", "विषय: आरोप पत्र", "पत्रांक--/दिनांक--"],
    3: ["सामान्य सूचना"],
    4: ["सेवा में"],
}


HEADS = {  # line: (which documents have it, its text)
    "office": ("true", "'कार्यालय, ' || source"),
    "blank": ("doc_id % 3 = 0", "'पत्रांक-------/दिनांक-------'"),
    "number": ("doc_id % 3 = 1", "'पत्रांक ' || doc_id || ' / दिनांक ' || n_chars"),
    "from": ("doc_id % 5 = 0", "'प्रेषक,'"), "sender": ("doc_id % 5 = 0", "'प्रभारी ' || source"), "place": ("doc_id % 5 = 0", "lang"),
    "to": ("doc_id % 2 = 0", "'सेवा में,'"), "who": ("doc_id % 2 = 0", "'प्रबंधक ' || source"), "branch": ("doc_id % 4 = 0", "'शाखा ' || lang"),
    "subject": ("doc_id % 7 > 1", "'विषय :- ' || lang || ' ' || source"), "empty": ("doc_id % 7 = 0", "'विषय:'"),
    "context": ("doc_id % 11 = 0", "'प्रसंग :- पत्रांक ' || n_chars"), "copy": ("doc_id % 4 = 1", "'प्रतिलिपि :- ' || source"), "again": ("doc_id % 8 = 1", "'प्रतिलिपि - ' || lang"),
}


def letter_rows(spark, sf_dir):
    odd = spark.createDataFrame([(-k, v) for k, v in LETTER_LINES.items()], "letter_id long, lines array<string>")
    head = F.filter(F.array(*[F.when(F.expr(c), F.expr(x)) for c, x in HEADS.values()]), lambda x: x.isNotNull())
    d = table(spark, sf_dir, "documents")
    return odd.unionAll(d.select(F.col("doc_id").alias("letter_id"), F.concat(head, F.coalesce(tx.text_lines("text"), F.array().cast("array<string>"))).alias("lines")))


def exploded_lines(rows, *kept):
    """``kept, i, x`` for each line. For ``explode`` Spark adds a filter on the array's size, pushes it down to the scan and computes the array there once more for each use; not for ``explode_outer``."""
    return rows.select(*kept, F.posexplode_outer("lines").alias("i", "x")).where("i IS NOT NULL")


def values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) + ")" for r in rows)


L = f"""SELECT id, i, x FROM (VALUES {values((-k, i, x) for k, v in LETTER_LINES.items() for i, x in enumerate(v))}) t(id, i, x)
UNION ALL SELECT doc_id, i - 100, x FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, [{", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in HEADS.values())}] AS ls FROM documents)) WHERE x IS NOT NULL
UNION ALL SELECT doc_id, line_no, line FROM ({LINES})"""
REF = r"पत्रांक\s*[:\-.]*\s*([^\s/]*)\s*/?\s*दिनांक\s*[:\-.]*\s*(\S*)"


def labelled_sql(word, marks):
    return rf"(SELECT trim(regexp_extract(x, '^\s*{word}\s*[{marks}]*\s*(.*)$', 1)) AS v FROM l WHERE l.id = k.id AND regexp_matches(x, '^\s*{word}') AND trim(regexp_extract(x, '^\s*{word}\s*[{marks}]*\s*(.*)$', 1)) <> '' ORDER BY i LIMIT 1)"


def reference_sql(group):
    given = rf"regexp_extract(x, '{REF}', {{}})"
    blank = r"regexp_full_match({}, '[.\-_\s]*')"
    own = f"CASE WHEN NOT {blank.format(given.format(group))} THEN {given.format(group)} END"
    return f"(SELECT {own} FROM l WHERE l.id = k.id AND regexp_matches(x, '{REF}') AND NOT ({blank.format(given.format(1))} AND {blank.format(given.format(2))}) ORDER BY i LIMIT 1)"


def ahead_sql(trigger, stop):
    return f"""(SELECT nullif(trim(concat_ws(' ', CASE WHEN NOT sa THEN a END, CASE WHEN NOT sa AND NOT sb THEN b END, CASE WHEN NOT sa AND NOT sb AND NOT sc THEN c END)), '') AS v FROM (
SELECT id, i, x, lead(trim(x), 1) OVER w AS a, lead(trim(x), 2) OVER w AS b, lead(trim(x), 3) OVER w AS c, coalesce(lead({stop}, 1) OVER w, true) AS sa, coalesce(lead({stop}, 2) OVER w, true) AS sb, coalesce(lead({stop}, 3) OVER w, true) AS sc FROM l WINDOW w AS (PARTITION BY id ORDER BY i)) z
WHERE z.id = k.id AND regexp_matches(x, '{trigger}') AND NOT sa ORDER BY i LIMIT 1)"""


TO = r"सेवा\s*में"
STOP_TO = r"(trim(x) = '' OR regexp_matches(x, '^\s*(विषय|प्रसंग)'))"
STOP_BY = rf"(trim(x) = '' OR regexp_matches(x, '{TO}'))"
KIND = "CASE WHEN regexp_matches(t, 'आदेश|आरोप|अभिकथन|निलंबित|दोषी') THEN 'disciplinary_order' WHEN regexp_matches(t, 'अग्रसारित|अनुरोध|प्रेषित|अग्रलेख') THEN 'forwarding_request' ELSE 'general_correspondence' END"


METADATA = rf"""WITH l AS ({L}), k AS (SELECT id, string_agg(x, chr(10) ORDER BY i) AS t FROM l GROUP BY id)
SELECT id AS letter_id, {labelled_sql('विषय', ':\\-।').replace('\\\\', '\\')} AS subject, {labelled_sql('प्रसंग', ':\\-।').replace('\\\\', '\\')} AS context_reference, {reference_sql(1)} AS reference_number, {reference_sql(2)} AS reference_date,
{ahead_sql(TO, STOP_TO)} AS recipient_designation, {ahead_sql(r'^\s*प्रेषक\s*[,:]*\s*$', STOP_BY)} AS sender_designation, {KIND} AS letter_type FROM k"""


@query(METADATA)
def metadata_fields(spark, sf_dir):
    return metadata.extract(letter_rows(spark, sf_dir)).select("letter_id", *metadata.FIELDS, "letter_type")


@query(rf"""WITH l AS ({L}) SELECT id AS letter_id, string_agg(c, '|' ORDER BY i) AS copy_to FROM (SELECT id, i, nullif(trim(regexp_extract(x, '^\s*प्रतिलिपि\s*[:\-]*\s*(.*)$', 1)), '') AS c FROM l) WHERE c IS NOT NULL GROUP BY id""")
def copy_to(spark, sf_dir):
    return metadata.extract(letter_rows(spark, sf_dir)).where(F.size("copy_to") > 0).select("letter_id", F.array_join("copy_to", "|").alias("copy_to"))


# Of the labels that occur in a letter: was a value found?
LABELS = {"subject": r"^\s*विषय", "context_reference": r"^\s*प्रसंग", "reference_number": REF, "reference_date": REF, "recipient_designation": TO, "sender_designation": r"^\s*प्रेषक\s*[,:]*\s*$"}
CONFIDENCE = " UNION ALL ".join(f"SELECT letter_id, '{f}' AS field, {f} IS NOT NULL AS ok FROM ({METADATA}) m WHERE EXISTS (SELECT 1 FROM ({L}) z WHERE z.id = m.letter_id AND regexp_matches(z.x, '{p}'))" for f, p in LABELS.items())


@query(CONFIDENCE)
def field_confidence(spark, sf_dir):
    return metadata.extract(letter_rows(spark, sf_dir)).select("letter_id", F.explode_outer("field_confidence").alias("field", "ok")).where("field IS NOT NULL")  # not explode: see exploded_lines


@query(f"SELECT letter_id, field FROM ({CONFIDENCE}) WHERE NOT ok")
def low_confidence_fields(spark, sf_dir):
    return metadata.extract(letter_rows(spark, sf_dir)).select("letter_id", F.explode_outer("low_confidence_fields").alias("field")).where("field IS NOT NULL")


@query(rf"WITH l AS ({L}) SELECT id AS letter_id, bool_or(regexp_matches(x, '^\s*विषय([^\p{{L}}\p{{N}}_]|$)')) AS matched_subject, bool_or(regexp_matches(x, '{TO}')) AS matched_service_to FROM l GROUP BY id")
def segment_flags(spark, sf_dir):
    lines = letter_rows(spark, sf_dir).select(F.col("letter_id").alias("source_file"), F.posexplode("lines").alias("line_no", "text"))
    return segment.segment_flags(lines, segment.segments(lines)).select(F.col("source_file").alias("letter_id"), "matched_subject", "matched_service_to")


SCORED = ["", "  ", "Plain Latin text", "सेवा में,", "विषय आदेश", "ंंंं", "्रविष्वासभाजन", "विश्वासभाजन", "१२३", "भा0प्र0से0 ABC", "जिला।"]
FINDS = "regexp_extract_all(t, '[ऀ-ॿ]+')"


def scored_sql(rows):
    """``rows`` (with a text ``t``) and how plausible the text is as Hindi."""
    return rf"""(WITH x AS ({rows}), y AS (SELECT *, length(regexp_replace(t, '[\s\p{{Nd}}.,;:\-/()\[\]]', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '[ऀ-ॿ]', '', 'g')) AS own, {FINDS} AS w FROM x),
z AS (SELECT *, CASE WHEN letters = 0 THEN 0 ELSE own / letters END AS ratio, len(list_filter(w, lambda q: q IN ({', '.join(f"'{w}'" for w in pl.COMMON_WORDS)}))) AS hits, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda q: contains('{pl.COMBINING}', q[1]))) / len(w) END AS bad FROM y)
SELECT *, CASE WHEN trim(t) = '' OR ratio = 0 THEN 1 ELSE greatest(least(ratio + least(0.05 * hits, 0.3) - 0.6 * bad, 1), 0) END AS score FROM z)"""


ODD = f"SELECT -1 - id AS id, 0 AS i, t FROM (VALUES {values((i, s) for i, s in enumerate(SCORED))}) v(id, t)"


@query(f"SELECT id, i::INT AS i, round(ratio, 6)::DOUBLE AS ratio, hits::INT AS hits, round(bad, 6)::DOUBLE AS bad, round(score, 6)::DOUBLE AS score FROM {scored_sql(f'{ODD} UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1, x FROM ({L}) WHERE id >= 0')}")
def plausibility(spark, sf_dir):
    """Of every line of the letters."""
    rows = spark.createDataFrame([(-1 - i, 0, t) for i, t in enumerate(SCORED)], "id long, i int, t string")
    rows = rows.unionAll(exploded_lines(letter_rows(spark, sf_dir).where("letter_id >= 0"), "letter_id"))
    return rows.select("id", "i", F.round(pl.devanagari_ratio("t"), 6).alias("ratio"), pl.common_word_hits("t").alias("hits"), F.round(pl.malformed_ratio("t"), 6).alias("bad"), F.round(pl.plausibility("t"), 6).alias("score"))


FONTS = ["DevLys 040", " Kruti Dev 041", "kruti dev", "Mangal", "Times New Roman", "ABCDEF+DevLys", "DV-TTYogesh", "Mangal Kruti Dev", "Shusha02", "", None]


def begins(words):
    return f"len(list_filter([{', '.join(f"'{w}'" for w in words)}], lambda p: starts_with(lower(trim(font)), p))) > 0"


@query(f"SELECT font, coalesce({begins(fonts.LEGACY)} AND NOT {begins(fonts.PASSTHROUGH)}, false) AS legacy FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN name ELSE name || ' ' || source END AS font FROM documents JOIN (VALUES {values((i, f) for i, f in enumerate(FONTS))}) t(n, name) ON n = doc_id % {len(FONTS)})")
def font_class(spark, sf_dir):
    """Font names, plain or with a source behind them."""
    name = F.element_at(F.array(*[F.lit(f) for f in FONTS]), (F.col("doc_id") % len(FONTS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.concat(name, F.lit(" "), "source")).alias("font")).select("font", fonts.is_legacy_font("font").alias("legacy"))


MARKS = ["", "--- ._", None, "75", "-7-", " . ", "_", "।", "- / -"]


# What stands behind the last letter or digit of each line, and of each letter's number.
@query(rf"""SELECT v, count(*) AS n, bool_and(v IS NULL OR regexp_full_match(v, '[.\-_\s]*')) AS placeholder FROM (SELECT v FROM (VALUES {values((v,) for v in MARKS)}) t(v) UNION ALL SELECT regexp_extract(x, '([^A-Za-z0-9]*)$', 1) FROM ({L}) UNION ALL SELECT regexp_extract(x, '{REF}', 1) FROM ({L})) GROUP BY v""")
def placeholder(spark, sf_dir):
    lines = exploded_lines(letter_rows(spark, sf_dir)).select("x")
    # What ends a line begins it when it is turned round, where one step finds it; lines without the label have no number.
    end = F.reverse(F.regexp_extract(F.reverse("x"), r"\A[^A-Za-z0-9]*", 0))
    number = F.when(F.col("x").contains("पत्रांक"), F.regexp_extract("x", REF, 1)).otherwise("")
    found = lines.select(F.explode(F.array(end, number)).alias("v"))
    rows = spark.createDataFrame([(v,) for v in MARKS], "v string").unionAll(found)
    return rows.groupBy("v").agg(F.count("*").alias("n")).select("v", "n", metadata.is_placeholder("v").alias("placeholder"))


OCR_WORDS = [(1, "सेवा", 90.0), (1, "में", 70.0), (1, " ", 95.0), (1, "x", -1.0), (2, "low", 40.0), (3, "", 10.0)]


# Order lines as words that OCR has read: a page for each order, blanks and words without a confidence among them.
WORDS = f"SELECT page, text, conf::DOUBLE AS conf FROM (VALUES {values((-p, t, c) for p, t, c in OCR_WORDS)}) t(page, text, conf) UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE l_returnflag END, l_quantity * 2 - 5 FROM lineitem"


@query(f"SELECT page, coalesce(avg(conf) FILTER (trim(text) <> '' AND conf >= 0), 0)::DOUBLE AS mean, coalesce(avg(conf) FILTER (trim(text) <> '' AND conf >= 0), 0) < 60 AS low FROM ({WORDS}) GROUP BY page")
def ocr_confidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("page"), F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_quantity") * 2 - 5).cast("double").alias("conf"))
    rows = spark.createDataFrame([(-p, t, c) for p, t, c in OCR_WORDS], "page long, text string, conf double").unionAll(lines)
    pages = rows.groupBy("page").agg(F.collect_list(F.struct("text", "conf")).alias("w"))  # the words of one page
    return pages.select("page", pl.ocr_confidence("w").alias("o")).select("page", "o.mean", "o.low")


# Typed lines: clusters, upper and lower r, the i-sign, nukta, digits, marks; and the benchmark's texts, which mean nothing in the font.
TYPED = ["fo|ky;", "LokLF;", 'jk"Vªh;', "deZpkjh oxZ", "Ldwy esa fdrkc]", "bZ'oj", "fnukad ƒ„&…†", "'kqØokj", "lM+d", "O;oLFkk¼[k½", "iz/kkuk/;kid", "", "kZf", "ff Z"]


def chart_sql(raw):
    """The chart by one alternation over its keys, then the rules about the order of signs."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    keys = "|".join(re.sub(r"([^\w\s])", r"\\\1", k) if k.isascii() else k for k, _ in fonts.KEYS)
    own = f"map([{', '.join(quoted(k) for k, _ in fonts.KEYS)}], [{', '.join(quoted(v) for _, v in fonts.KEYS)}])"
    return arranged_sql(f"array_to_string(list_transform(regexp_extract_all({raw}, {quoted('(?s)' + keys + '|.')}), lambda x: coalesce({own}[x], x)), '')")


def arranged_sql(t):
    t = f"replace({t}, '्ा', '')"
    c, m = f"[{fonts.CONSONANT}]़?", fonts.MATRA
    t = f"replace(regexp_replace({t}, 'f((?:{c}्)*{c})', '\\1ि', 'g'), 'f', 'ि')"
    t = f"regexp_replace({t}, '((?:{c}्)*{c})([{m}]*)Z', 'र्\\1\\2', 'g')"
    t = f"replace(regexp_replace({t}, '^([{m}]*)Z', 'र्\\1'), 'Z', 'र्')"
    t = f"regexp_replace(regexp_replace({t}, '्{{2,}}', '्', 'g'), '्([{m}])', '\\1', 'g')"
    return f"regexp_replace({t}, '[ ,]([{''.join(x for x in m if x not in 'ंःँ')}])', '\\1', 'g')"


@query(f"SELECT md5(raw) AS raw, {chart_sql('raw')} AS decoded FROM (SELECT text AS raw FROM benchmark UNION ALL VALUES {', '.join("('" + t.replace("'", "''") + "')" for t in TYPED)})")
def legacy_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("text").alias("raw")).unionAll(spark.createDataFrame([(t,) for t in TYPED], "raw string"))
    return rows.select(F.md5("raw").alias("raw"), fonts.decode_legacy()("raw").alias("decoded"))


# A table in which what one pair prints is a key of a later one, and keys overlap: "th" prints what "Fk" is, "an" turns round, "s" comes too late for "मs".
ORDERED = fonts.Ordered([("pkS", "चौ"), ("saz", "Zें"), ("kas", "ाेa"), ("th", "Fk"), ("Fk", "थ"), ("e", "म"), ("मs", "मे"), ("an", "na"), ("nn", "न्न"), ("n", "न"), ("s", "े"), ("it", "tf"), ("tf", "Zत"), ("k", "ा"), ("r", "Z"), ("a", "ं")])


@query(f"SELECT doc_id, md5(decoded) AS decoded, length(decoded) AS n_signs FROM (SELECT doc_id, {arranged_sql(functools.reduce(lambda t, p: f"replace({t}, '{p[0]}', '{p[1]}')", ORDERED, 'text'))} AS decoded FROM documents WHERE text IS NOT NULL)")
def ordered_decode(spark, sf_dir):
    """A table from a file is applied in its order, each pair over the whole text; the documents are typed in a font of its own kind."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", fonts.decode_legacy(ORDERED)("text").alias("decoded"))
    return d.select("doc_id", F.md5("decoded").alias("decoded"), F.length("decoded").cast("long").alias("n_signs"))


# Runs of one file: legacy fonts and others in turn, empty runs, a line without any text.
RUNS = [
    ("a", 0, 0, "DevLys 040", "f"), ("a", 0, 1, "Kruti Dev 010", "tyk inkf"), ("a", 0, 2, "DevLys 040", "/kdkjh"), ("a", 0, 3, "Calibri", " ABC "), ("a", 0, 4, None, ""), ("a", 0, 5, "DevLys 040", "lsok esa]"),
    ("a", 1, 0, None, "विषय : आदेश"), ("a", 1, 1, "Mangal", " के संबंध में"), ("a", 2, 0, "Mangal", ""), ("a", 3, 0, "Arial", "plain"), ("b", 0, 0, "DevLys", "aaa"), ("b", 0, 1, "Times", "  "),
]
RUN_ROWS = f"""SELECT f, l, r, font, x FROM (VALUES {values(RUNS)}) v(f, l, r, font, x)
UNION ALL SELECT 'b' || row_number() OVER (ORDER BY item_id, text), 0, unnest([0, 1, 2, 3]), unnest(['DevLys 010', ' kruti dev', 'Mangal', 'Kruti Dev 010']), unnest([text, 'k', ' ' || item_id || ' ', text]) FROM benchmark WHERE text IS NOT NULL"""
GROUPS = f"""SELECT f, l, g, bool_or(legacy) AS legacy, string_agg(x, '' ORDER BY r) AS raw FROM (
SELECT *, sum(c) OVER (PARTITION BY f, l ORDER BY r) AS g FROM (SELECT *, CASE WHEN legacy IS NOT DISTINCT FROM lag(legacy) OVER (PARTITION BY f, l ORDER BY r) THEN 0 ELSE 1 END AS c FROM (
SELECT *, coalesce({begins(fonts.LEGACY)} AND NOT {begins(fonts.PASSTHROUGH)}, false) AS legacy FROM ({RUN_ROWS}) WHERE x <> ''))) GROUP BY f, l, g"""


@query(f"""WITH d AS (SELECT f, l, g, t, score FROM {scored_sql(f"SELECT f, l, g, CASE WHEN legacy THEN {chart_sql('raw')} ELSE raw END AS t FROM ({GROUPS})")}),
n AS (SELECT DISTINCT f, l FROM ({RUN_ROWS}))
SELECT n.l AS line_no, coalesce(string_agg(t, '' ORDER BY g), '') AS text, round(coalesce(min(score) FILTER (trim(t) <> ''), 1), 6)::DOUBLE AS min_plausibility FROM n LEFT JOIN d ON d.f = n.f AND d.l = n.l GROUP BY n.f, n.l""")
def run_routing(spark, sf_dir):
    """Runs are grouped by font class, legacy groups decoded, and a line is as plausible as its least plausible group. Each benchmark text is typed twice in legacy fonts."""
    four = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(font).alias("font"), x.alias("x")) for r, font, x in ((0, "DevLys 010", F.col("text")), (1, " kruti dev", F.lit("k")), (2, "Mangal", F.concat(F.lit(" "), "item_id", F.lit(" "))), (3, "Kruti Dev 010", F.col("text")))])
    typed = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.concat(F.lit("b"), F.hex(F.concat_ws("/", F.col("item_id").cast("string"), F.md5("text")))).alias("source_file"), F.explode(four).alias("q"))
    typed = typed.select("source_file", F.lit(0).alias("line_no"), F.col("q.r").alias("run_no"), F.col("q.font").alias("font_name"), F.col("q.x").alias("text"))
    runs = spark.createDataFrame(RUNS, "source_file string, line_no int, run_no int, font_name string, text string").unionAll(typed).withColumn("page_break_before", F.lit(False))
    return files.decoded_lines(runs).select("line_no", "text", F.round("min_plausibility", 6).alias("min_plausibility"))


# Stand-ins for PDF files: pages end with a form feed; where a page has too little text, "OCR" reads the page's words in capitals.
SCANS = [("a.pdf", "a line of more than twenty signs\n \nsecond line\fshort\n  page \fagain a line of more than twenty\n"), ("b.pdf", "   \n")]


def pages_of(content):
    return [[[(line, None)] for line in page.split("\n")] for page in content.decode().split("\f")]


def joined_words(content, page_no):
    return content.decode().split("\f")[page_no].replace(" ", "_"), 45.0


PAGES = f"SELECT f, x FROM (VALUES {values(SCANS)}) v(f, x) UNION ALL SELECT 'doc' || doc_id || '.pdf', replace(text, '.' || chr(10), '.' || chr(12)) FROM documents WHERE text IS NOT NULL"


@query(f"""WITH p AS (SELECT f, unnest(string_split(x, chr(12))) AS page, generate_subscripts(string_split(x, chr(12)), 1) AS n FROM ({PAGES})),
l AS (SELECT f, n, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) AS i FROM p),
k AS (SELECT *, sum(length({STRIP % 'line'})) OVER (PARTITION BY f, n) < 20 AS low FROM l),
o AS (SELECT f, n, i, low, CASE WHEN low THEN replace(line, ' ', '_') ELSE line END AS text FROM k),
r AS (SELECT * FROM o WHERE {STRIP % 'text'} <> '')
SELECT f AS source_file, (row_number() OVER (PARTITION BY f ORDER BY n, i) - 1)::INT AS line_no, text, i = min(i) OVER (PARTITION BY f, n) AS page_break_before, CASE WHEN low THEN 0.45 ELSE 1 END::DOUBLE AS min_plausibility FROM r""")
def pdf_scan(spark, sf_dir):
    """Every document as such a file, whose pages end where a line ends with a full stop."""
    found = spark.createDataFrame([(f, ".pdf", bytearray(x.encode())) for f, x in SCANS], "source_file string, suffix string, content binary")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.format_string("doc%d.pdf", "doc_id").alias("source_file"), F.lit(".pdf").alias("suffix"), F.encode(F.replace("text", F.lit(".\n"), F.lit(".\f")), "UTF-8").alias("content"))
    return files.decoded_lines(files.pdf_files(found.unionByName(d), pages_of, joined_words))


LETTER = "सेवा में,\nप्रबंधक\n\nविषय: नमूना"
NOTE = "विषय: सूचना\n\n  दो   शब्द \n"


def sample_tree(spark) -> str:
    """A small tree of letters in a folder that executors can read."""
    tree = {"revenue/note.txt": NOTE.encode(), ".meta/skip.txt": b"not a letter"}
    with tempfile.TemporaryDirectory(prefix="letterloom-sample-") as folder:
        tree["education/office/letter.docx"] = export.write_docx(LETTER, Path(folder) / "letter.docx").read_bytes()
    root = f"{shared(spark)}/letterloom-sample"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, content in tree.items():
        out = fs.create(path(f"{root}/{name}"), True)
        out.write(content)
        out.close()
    return root


def typed_files(spark, sf_dir, suffixes):
    """Every document as a file ``source/lang/doc<id>`` with one of the suffixes in turn: text as it is, or a word-processor file with a paragraph for each line."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("suffix", F.element_at(F.array(*map(F.lit, suffixes)), F.pmod("doc_id", F.lit(len(suffixes))).cast("int") + 1))
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.format_string("/doc%d", "doc_id"), "suffix").alias("source_file")
    typed = export.docx_column(F.when(F.col("suffix") == ".docx", F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return d.select(name, "suffix", F.coalesce(typed, F.encode("text", "UTF-8")).alias("content"))


FILED = "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc' || doc_id"
PARAGRAPHS = f"""SELECT f, row_number() OVER (PARTITION BY f ORDER BY j) - 1 AS i, t FROM (
SELECT f, unnest(ls) AS t, generate_subscripts(ls, 1) AS j FROM (SELECT {FILED} || '.docx' AS f, string_split({STRIP % 'text'}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE {STRIP % 't'} <> ''
UNION ALL SELECT 'education/office/letter.docx', i - 1, t FROM (SELECT unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT string_split({values([(LETTER,)])[1:-1]}, chr(10) || chr(10)) AS ls))"""


@query(f"SELECT f AS source_file, i::INT AS line_no, t AS text, false AS page_break_before, round(score, 6)::DOUBLE AS min_plausibility FROM {scored_sql(PARAGRAPHS)}")
def docx_scan(spark, sf_dir):
    """A small tree that lies in a folder, and every document as a file."""
    found = files.scan(spark, sample_tree(spark)).select("source_file", "suffix", "content").unionByName(typed_files(spark, sf_dir, [".docx"]))
    return files.decoded_lines(files.docx_files(found)).withColumn("min_plausibility", F.round("min_plausibility", 6))


TREE = f"SELECT * FROM (VALUES {values([('education/office/letter.docx', LETTER), ('revenue/note.txt', NOTE)])}) v(path, content)"


@query(rf"""WITH f AS (SELECT path, string_split(path, '/') AS s, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM ({TREE})),
l AS (SELECT path, s, i, trim(regexp_replace(line, '[ 	]{{2,}}', ' ', 'g')) AS x FROM f WHERE trim(line) <> ''),
t AS (SELECT path, any_value(s) AS s, string_agg(x, chr(10) ORDER BY i) AS text, arg_min(nullif(trim(regexp_extract(x, '^विषय\s*[:\-।]*\s*(.*)$', 1)), ''), i) FILTER (starts_with(x, 'विषय')) AS subject FROM l GROUP BY path)
SELECT regexp_replace(s[-1], '\.[^.]*$', '') || '__seg000' AS letter_id, s[1] AS department, CASE WHEN len(s) > 2 THEN s[2] ELSE 'unknown' END AS office, path AS source_file, subject, {KIND.replace('(t,', '(text,')} AS letter_type, text, false AS needs_review FROM t
UNION ALL SELECT 'doc' || doc_id || '__seg000', coalesce(source, 'none'), coalesce(lang, 'none'), {FILED} || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.docx' END, NULL, 'general_correspondence', coalesce(text, ''), false FROM (
SELECT d.doc_id, source, lang, string_agg(c, chr(10) ORDER BY i) AS text FROM documents d LEFT JOIN (SELECT doc_id, i, {CLEAN} AS c FROM ({SPLIT}) WHERE {STRIP % 'line'} <> '') l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY ALL) WHERE doc_id % 2 = 0 OR text IS NOT NULL""")
def ingest_tree(spark, sf_dir):
    """A small tree that lies in a folder, and every document as a file, text and word-processor files in turn."""
    found = files.scan(spark, sample_tree(spark)).select("source_file", "suffix", "content").unionByName(typed_files(spark, sf_dir, [".txt", ".docx"]))
    return ingest.ingest_files(found).select("letter_id", "department", "office", "source_file", "subject", "letter_type", "text", "needs_review")
