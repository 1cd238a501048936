"""Queries over stores that last: a keyword index, vectors by cell, embeddings made once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodestrata.functions.embedding import embedded
from lodestrata.plans.registry import query
from lodestrata.plans.search import WORDS, bm25_sql
from lodestrata.runtime import scratch, table
from lodestrata.sources.document_sink import write_documents
from lodestrata.sources.embedding_cache import EmbeddingCache
from lodestrata.sources.json_stores import SessionIndex, array_records, records, sessions, transcript
from lodestrata.sources.keyword_index import KeywordIndex
from lodestrata.sources.vector_store import VectorStore


def _older(docs):
    """An earlier state of a table: some rows are missing, some had other texts, and some are gone by now."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("the shed of "), "lang")).otherwise(F.col("text"))
    rows = docs.where("doc_id % 5 > 0").select("doc_id", text.alias("text"))
    return rows.unionByName(docs.where("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))


@query("v7_index", f"WITH {bm25_sql(WORDS)} SELECT doc_id, score FROM bm")
def v7_index(spark, sf_dir):
    """An index of an earlier state, brought up to date and then searched."""
    docs = table(spark, sf_dir, "documents")
    index = KeywordIndex(spark, scratch(spark, "keyword-index"))
    index.refresh(_older(docs))
    index.refresh(docs)
    return index.bm25(WORDS)


@query(
    "v7_refresh",
    """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'the shed of ' || lang ELSE text END AS text FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT -doc_id - 1, text FROM documents WHERE doc_id % 11 = 0)
SELECT CASE WHEN a.doc_id IS NULL THEN 'inserted' WHEN d.doc_id IS NULL THEN 'deleted' WHEN a.text = d.text THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n FROM a FULL JOIN documents d USING (doc_id) GROUP BY 1
""",
)
def v7_refresh(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = KeywordIndex(spark, scratch(spark, "keyword-index"))
    index.refresh(_older(docs))
    return spark.createDataFrame([(a, n) for a, n in index.refresh(docs).items() if n], "action string, n long")


@query("s8_store")
def s8_store(spark, sf_dir):
    """The ten nearest vectors of every row with an id divisible by 50, from the probed cells of a store.

    Tests measure the recall against all rows; SQL has no cells.
    """
    vectors = table(spark, sf_dir, "embeddings")
    store = VectorStore(spark, scratch(spark, "vector-store"))
    store.save(vectors.select("vec_id", "embedding"))
    return store.search(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("s8_round_trip", "SELECT vec_id, CAST(label AS INTEGER) AS label, len(embedding) AS entries, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def s8_round_trip(spark, sf_dir):
    """What is saved, replaced and loaded again."""
    vectors = table(spark, sf_dir, "embeddings")
    store = VectorStore(spark, scratch(spark, "vector-store"))
    store.save(vectors.where("vec_id % 2 = 0"))
    store.save(vectors)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.load().select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").cast("long").alias("entries"), F.round(total, 6).alias("total"))


@query(
    "v4_cache",
    """
WITH a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 > 0), b AS (SELECT DISTINCT text FROM documents), m AS (SELECT count(*) AS n FROM a), n AS (SELECT count(*) AS n FROM b)
SELECT 1 AS pass, 0 AS found, n AS embedded FROM m UNION ALL SELECT 2, m.n, n.n - m.n FROM m, n UNION ALL SELECT 3, n, 0 FROM n UNION ALL SELECT 4, 0, n FROM n
""",
)
def v4_cache(spark, sf_dir):
    """Some documents, then all, then all again, and all when the entries have expired: texts found and texts embedded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = EmbeddingCache(spark, scratch(spark, "embedding-cache"), "hash-64", lambda df: embedded(df, dimension=64))
    day = dt.datetime(2024, 5, 1)
    passes = [(docs.where("doc_id % 3 > 0"), day), (docs, day), (docs, day + dt.timedelta(days=29)), (docs, day + dt.timedelta(days=60))]
    counts = [cache.embeddings(rows, now)[1] for rows, now in passes]
    return spark.createDataFrame([(i + 1, c["found"], c["embedded"]) for i, c in enumerate(counts)], "pass int, found long, embedded long")


def _array_files(spark, sf_dir) -> str:
    """Turns as array files: of ten files three are cut short and one is an object; each list ends with a number and a string."""
    path = scratch(spark, "array-files")
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.col("conv_id") % 10)
    lists = turns.groupBy("part").agg(F.to_json(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text")))).alias("list"))
    open_ = F.concat(F.expr("substr(list, 1, length(list) - 1)"), F.lit(', 5, "{}"'))
    text = F.when(F.col("part") % 3 == 1, open_).when(F.col("part") == 9, F.concat(F.lit('{"list": '), open_, F.lit("]}"))).otherwise(F.concat(open_, F.lit("]")))
    lists.select("part", text.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return path


@query("s10_records", "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations WHERE conv_id % 10 % 3 <> 1 AND conv_id % 10 <> 9")
def s10_records(spark, sf_dir):
    rows = records(spark, _array_files(spark, sf_dir), "conv_id long, turn long, role string, text string", "*.txt")
    return rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query(
    "s10_rejects",
    "WITH p AS (SELECT DISTINCT conv_id % 10 AS part FROM conversations) SELECT CASE WHEN part % 3 = 1 THEN 'no json' WHEN part = 9 THEN 'no list' ELSE 'no object' END AS reject, CAST(sum(CASE WHEN part % 3 = 1 OR part = 9 THEN 1 ELSE 2 END) AS BIGINT) AS n FROM p GROUP BY 1",
)
def s10_rejects(spark, sf_dir):
    rows = array_records(spark, _array_files(spark, sf_dir), "*.txt").where("reject IS NOT NULL")
    return rows.groupBy("reject").agg(F.count("*").alias("n"))


def _session_files(spark, sf_dir) -> str:
    """A snapshot for each conversation; every seventh is broken."""
    path = scratch(spark, "sessions")
    turns = table(spark, sf_dir, "conversations")
    message = F.struct("turn", "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    whole = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("session_id"), "messages", (F.col("conv_id") * 7 % 1000).cast("double").alias("created_at")))
    text = F.when(F.col("conv_id") % 7 == 3, F.substring(whole, 1, 40)).otherwise(whole)
    documents = held.select(F.concat(F.lit("session-s"), F.col("conv_id"), F.lit(".json")).alias("name"), text.alias("body"))
    write_documents(documents, path)
    return path


@query(
    "s25_sessions",
    """
WITH u AS (SELECT conv_id, count(*) AS message_count, arg_min(trim(text), turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS first FROM conversations WHERE conv_id % 7 <> 3 GROUP BY conv_id)
SELECT 's' || conv_id AS session_id, coalesce(substr(first, 1, 80), '') AS summary, message_count, '' AS model, CAST(conv_id * 7 % 1000 AS DOUBLE) AS created_at FROM u ORDER BY created_at DESC, session_id LIMIT 20
""",
)
def s25_sessions(spark, sf_dir):
    """The newest sessions by what they say of themselves; all files are asked for, as their times are those of this run."""
    return sessions(spark, _session_files(spark, sf_dir), None).orderBy(F.col("created_at").desc(), "session_id").limit(20)


@query(
    "s26_index",
    """
WITH t AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, n, CASE WHEN conv_id % 3 = 0 THEN chars + 100000 ELSE chars END AS updated FROM t WHERE conv_id % 5 <> 2)
SELECT 's' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'renamed' ELSE 'new' END AS title, n AS message_count, CAST(updated AS DOUBLE) AS updated_at FROM e ORDER BY updated DESC, session_id LIMIT 100
""",
)
def s26_index(spark, sf_dir):
    """All sessions, of which a third is renamed and a fifth removed; then the hundred updated last."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(F.length("text")).cast("double").alias("updated_at"))
    rows = turns.select("conv_id", F.concat(F.lit("s"), "conv_id").alias("session_id"), F.lit("new").alias("title"), "message_count", F.lit(0.0).alias("created_at"), "updated_at")
    index = SessionIndex(spark, scratch(spark, "session-index"))
    index.upsert(rows.drop("conv_id"))
    index.upsert(rows.where("conv_id % 3 = 0").drop("conv_id").withColumn("title", F.lit("renamed")).withColumn("updated_at", F.col("updated_at") + 100_000))
    index.remove(rows.where("conv_id % 5 = 2").select("session_id"))
    return index.newest(100).select("session_id", "title", "message_count", "updated_at")


@query(
    "s34_transcripts",
    r"""
WITH p AS (SELECT conv_id, turn, chr(10) || '## ' || upper(role[1]) || lower(role[2:]) || chr(10) || CASE WHEN trim(text, ' ') <> '' THEN chr(10) || trim(text, ' ') ELSE '' END AS part FROM conversations),
m AS (SELECT conv_id, '# Session Transcript' || chr(10) || string_agg(part, chr(10) ORDER BY turn) || chr(10) AS markdown FROM p GROUP BY conv_id)
SELECT conv_id || '.md' AS name, sha256(markdown) AS text_sha256, strlen(markdown) AS n_bytes FROM m
""",
)
def s34_transcripts(spark, sf_dir):
    """Each conversation written as a Markdown document of its own, twice, and read back."""
    path = scratch(spark, "transcripts")
    notes = transcript(table(spark, sf_dir, "conversations"), "conv_id", "turn").select(F.concat("conv_id", F.lit(".md")).alias("name"), F.col("markdown").alias("body"))
    write_documents(notes.withColumn("body", F.lit("draft")), path)
    write_documents(notes, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("text_sha256"), F.col("length").alias("n_bytes"))
