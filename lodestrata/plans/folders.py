"""Queries over folders of files, which are written from documents first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodestrata.plans.parsing import _STRIP
from lodestrata.plans.registry import query
from lodestrata.runtime import scratch, settle, table
from lodestrata.sources import frontmatter as M
from lodestrata.sources import ingest as I
from lodestrata.sources.document_sink import write_documents

_KINDS = ["md", "txt", "json", "bin"]
#: Folders that a query's documents are dealt to, so that tasks list them side by side.
_FOLDERS = 1024


def _name():
    return F.regexp_extract("path", "([^/]*)$", 1)


def _plain_sql(text: str) -> str:
    lines = rf"regexp_replace(regexp_replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _STRIP.format(lines)


def _folder(spark, sf_dir, text=None, which=None) -> str:
    """Documents as files of four kinds; those in ``bin`` are no documents to the scan."""
    path = scratch(spark, "folder")
    docs = table(spark, sf_dir, "documents")
    docs = docs.where(which) if which is not None else docs
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.when(kind == "json", F.to_json(F.struct("doc_id", "lang"))).otherwise(text if text is not None else F.col("text"))
    write_documents(docs.select(F.concat(F.lit("d"), "doc_id", F.lit("."), kind).alias("name"), body.alias("body")), path, _FOLDERS)
    return path


@query(
    "s1_texts",
    f"""
SELECT 'd' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' ELSE 'json' END AS name, sha256(t) AS text_sha256, length(t) AS n_chars
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'doc_id: ' || doc_id || chr(10) || 'lang: ' || lang ELSE {_plain_sql('text')} END AS t FROM documents WHERE doc_id % 4 < 3 AND (doc_id % 4 = 2 OR text <> ''))
""",
)
def s1_texts(spark, sf_dir):
    read = I.with_text(I.files(spark, _folder(spark, sf_dir)))
    return read.select(_name().alias("name"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@query(
    "u3_replaced",
    rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'doc_id: ' || doc_id || chr(10) || 'lang: ' || lang ELSE {_plain_sql('text')} END AS t FROM documents WHERE doc_id % 4 < 3)
SELECT 'd' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' ELSE 'json' END AS name, substr({_STRIP.format("regexp_replace(split_part(t, chr(10), 1), '^[#" + chr(92) + "s*>-]+', '')")}, 1, 80) AS title, 'notes' AS category, 0 AS first, TRUE AS gapless FROM d WHERE t <> ''
""",
)
def u3_replaced(spark, sf_dir):
    """A folder is ingested, then a later state of it: chunks of changed files are replaced, those of removed ones go."""
    meta = {"category": "notes", "tags": "a,b"}
    none = spark.createDataFrame([], "path string, hash string, metadata_hash string")
    stored = spark.createDataFrame([], "path string, title string, chunk string, chunk_index int, token_count int, category string, tags string")
    named = lambda folder: I.files(spark, folder).withColumn("path", _name())
    older = F.when(F.col("doc_id") % 3 == 0, F.lit("an older text")).otherwise(F.col("text"))
    before = named(_folder(spark, sf_dir, older, "doc_id % 5 > 0"))
    chunks, state, _ = I.ingested(before, none, stored, meta)
    chunks, state = settle(chunks, "chunks"), settle(state, "state")
    chunks, _, _ = I.ingested(named(_folder(spark, sf_dir)), state, chunks, meta)
    per = chunks.groupBy("path").agg(F.first("title").alias("title"), F.first("category").alias("category"), F.min("chunk_index").alias("first"), (F.max("chunk_index") + 1 == F.countDistinct("chunk_index")).alias("gapless"), F.count("*").alias("n"))
    return per.select(F.col("path").alias("name"), "title", "category", "first", (F.col("gapless") & (F.col("n") == F.col("first") + F.col("n"))).alias("gapless"))


@query(
    "s7_report",
    """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'insert' WHEN doc_id % 4 <> 2 AND doc_id % 3 = 0 AND text <> 'an older text' THEN 'update' ELSE 'skip' END AS action, count(*) AS files FROM documents WHERE doc_id % 4 < 3 AND (text <> '' OR doc_id % 4 = 2) GROUP BY 1
UNION ALL SELECT 'other metadata', count(*) FROM documents WHERE doc_id % 4 < 3 AND (text <> '' OR doc_id % 4 = 2)
""",
)
def s7_report(spark, sf_dir):
    """What an import of a folder does to a store of its earlier state, and how many files other tags change."""
    meta = {"category": "notes"}
    none = spark.createDataFrame([], "path string, hash string, metadata_hash string")
    stored = spark.createDataFrame([], "path string, title string, chunk string, chunk_index int, token_count int, category string")
    named = lambda folder: I.files(spark, folder).withColumn("path", _name())
    older = F.when(F.col("doc_id") % 3 == 0, F.lit("an older text")).otherwise(F.col("text"))
    _, state, _ = I.ingested(named(_folder(spark, sf_dir, older, "doc_id % 5 > 0")), none, stored, meta)
    now = named(_folder(spark, sf_dir))
    _, later, report = I.ingested(now, settle(state, "state"), stored, meta)
    _, _, tagged = I.ingested(now, settle(later, "state"), stored, meta | {"tags": "x"})
    return report.unionByName(tagged.where("action = 'update'").select(F.lit("other metadata").alias("action"), "files"))


def _notes(spark, sf_dir) -> str:
    """Documents as notes with a head: some are disabled, some expire."""
    path = scratch(spark, "notes")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 28).cast("int"))
    lines = [F.lit("---"), F.concat(F.lit("title: 'note: "), "doc_id", F.lit("'")), F.concat(F.lit("lang: "), "lang"), F.concat(F.lit("updated_at: "), day.cast("string")), F.when(F.col("doc_id") % 3 == 0, F.lit("ttl_days: 10")), F.when(F.col("doc_id") % 5 == 0, F.lit("disabled: Yes")), F.when(F.col("doc_id") % 11 != 0, F.lit("---")), F.col("text")]
    write_documents(table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), "doc_id", F.lit(".md")).alias("name"), F.concat_ws("\n", *lines).alias("body")), path, _FOLDERS)
    return path


@query(
    "s22_notes",
    "SELECT 'n' || doc_id || '.md' AS name FROM documents WHERE doc_id % 11 = 0 OR (doc_id % 5 <> 0 AND NOT (doc_id % 3 = 0 AND doc_id % 28 + 10 <= 31))",
)
def s22_notes(spark, sf_dir):
    """Notes that are neither disabled nor expired on the first of February; a head that isn't closed is none."""
    files = I.files(spark, _notes(spark, sf_dir), (".md",))
    return M.live(files, F.lit(dt.datetime(2024, 2, 1))).select(_name().alias("name"))


@query(
    "s23_heads",
    """
SELECT 'n' || doc_id || '.md' AS name, CASE WHEN doc_id % 11 <> 0 THEN 'note: ' || doc_id END AS title, CASE WHEN doc_id % 11 <> 0 THEN lang END AS lang,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 3 + CAST(doc_id % 3 = 0 AS INT) + CAST(doc_id % 5 = 0 AS INT) END AS n_fields, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS body_sha256 FROM documents
""",
)
def s23_heads(spark, sf_dir):
    files = I.files(spark, _notes(spark, sf_dir), (".md",)).withColumn("head", M.head(F.col("text")))
    field = lambda k: F.try_element_at("head", F.lit(k)).alias(k)
    body = F.when(F.size("head") > 0, F.sha2(M.body(F.col("text")), 256))
    return files.select(_name().alias("name"), field("title"), field("lang"), F.size("head").alias("n_fields"), body.alias("body_sha256"))
