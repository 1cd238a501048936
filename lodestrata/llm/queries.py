"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, decontam, language_id, license_scan, line_dedup, ngram_join, quality, ranked_search, substring_dedup, token_output, toxicity, warc, whitening
from lodestrata.runtime import table

TOKENIZER = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written_documents(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified_documents(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_output": op6_token_output,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_language_id": op12_language_id,
    "op13_whitening": op13_whitening,
}

#: All pairs by their common n-grams, which is fine for small tables only.
_JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS k FROM w)
), c AS (SELECT w.doc_id, coalesce(sha256(string_agg(g, chr(10) ORDER BY g)), '') AS cls, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
k AS (SELECT cls, min(doc_id) AS id, count(*) AS copies, any_value(n) AS n FROM c GROUP BY cls),
r AS (SELECT k.id, g FROM k JOIN s ON s.doc_id = k.id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE 5 * i >= 4 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
g AS (SELECT id, min(other) AS least_id FROM reach GROUP BY id),
d AS (SELECT e.a AS id, count(*) AS links, CAST(sum(k.copies) AS BIGINT) AS docs FROM e JOIN k ON k.id = e.b GROUP BY e.a)
SELECT doc_id, k.id AS class_id, least(k.id, coalesce(least_id, k.id)) AS group_id, k.copies - 1 + coalesce(docs, 0) AS n_links, coalesce(links, 0) AS n_class_links
FROM c JOIN k USING (cls) LEFT JOIN g ON g.id = k.id LEFT JOIN d ON d.id = k.id
"""

SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_warc": warc.SQL,
    "op5_ngram_join": _JOIN_SQL,
    "op7_license_scan": license_scan.sql(),
    "op9_line_dedup": line_dedup.SQL,
    "op11_ranked_search": ranked_search.SQL,
}
