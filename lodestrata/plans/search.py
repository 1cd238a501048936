"""Queries of search and of conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.chunking import chunked
from lodestrata.functions.embedding import embedded
from lodestrata.functions.text import char_estimate, tokens
from lodestrata.operators import conversation as C
from lodestrata.operators import retrieval as R
from lodestrata.operators import windows as N
from lodestrata.plans.registry import query
from lodestrata.runtime import settle, table

#: Words of the searches below.
WORDS = "the license of haen the shed"
#: The vector searched for is one of the table.
VECTOR_ID = 7


def bm25_sql(words: str, where: str = "TRUE") -> str:
    toks = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))"
    asked = ", ".join(f"('{w}')" for w in words.lower().split())
    return f"""
d AS (SELECT doc_id, {toks} AS toks FROM documents WHERE {where}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS mean FROM d),
q AS (SELECT term, count(*) AS times FROM (VALUES {asked}) v(term) GROUP BY term),
tf AS (SELECT doc_id, term, times, len(list_filter(toks, lambda t: t = term)) AS tf, len(toks) AS length FROM d, q),
hit AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (
  SELECT doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM hit JOIN df USING (term), stats GROUP BY doc_id
)"""


@query("t_flagship", f"WITH {bm25_sql(WORDS)} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def flagship(spark, sf_dir):
    return R.top(R.bm25(table(spark, sf_dir, "documents"), WORDS), "score", "doc_id", 20)


@query("v6_bm25_scores", f"WITH {bm25_sql(WORDS)} SELECT doc_id, score FROM bm")
def v6_bm25_scores(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), WORDS)


@query("v8_bm25_filtered", "WITH " + bm25_sql("der und shed", "lang IN ('de', 'en')") + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def v8_bm25_filtered(spark, sf_dir):
    return R.top(R.bm25(table(spark, sf_dir, "documents").where("lang IN ('de', 'en')"), "der und shed"), "score", "doc_id", 50)


@query(
    "a12_document_frequency",
    "WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)))) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) "
    "SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term",
)
def a12_document_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(
    "a11_keywords",
    """
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ('the', 'and', 'of', 'to', 'in', 'is', 'de', 'la') GROUP BY ALL)
SELECT doc_id, term, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 8
""",
)
def a11_keywords(spark, sf_dir):
    stop = ["the", "and", "of", "to", "in", "is", "de", "la"]
    best = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.top_terms("text", 8, stop)).alias("t"))
    return best.select("doc_id", "t.term", "t.n")


@query(
    "a10_term_share",
    "WITH t AS (SELECT lang, doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM documents), n AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang) "
    "SELECT lang, term, count(*) AS docs, round(count(*) / any_value(total), 6) AS share FROM t JOIN n USING (lang) GROUP BY lang, term QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) <= 15",
)
def a10_term_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("term"))
    counts = terms.groupBy("lang", "term").agg(F.count("*").alias("docs"))
    best = N.latest(counts, ["lang"], [F.col("docs").desc(), F.col("term")], 15)
    return best.join(docs.groupBy("lang").agg(F.count("*").alias("total")), "lang").select("lang", "term", "docs", F.round(F.col("docs") / F.col("total"), 6).alias("share"))


_COSINE_SQL = f"""
qv AS (SELECT embedding AS e FROM embeddings WHERE vec_id = {VECTOR_ID}),
cos AS (SELECT vec_id, label, round(coalesce(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / nullif(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])), 0), 0), 6) AS score FROM embeddings, qv)"""


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").first()[0])


@query("k1_vector_top", f"WITH {_COSINE_SQL} SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 20")
def k1_vector_top(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20)


@query("k3_collections", f"WITH {_COSINE_SQL} SELECT label, vec_id, score FROM cos QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5")
def k3_collections(spark, sf_dir):
    literal = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    scored = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(R.cosine(F.col("embedding"), literal), 6).alias("score"))
    return N.latest(scored, ["label"], [F.col("score").desc(), F.col("vec_id")], 5).drop("rank")


@query(
    "k2_hybrid",
    f"""
WITH {_COSINE_SQL}, {bm25_sql(WORDS)},
v AS (SELECT vec_id AS doc_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 200), b AS (SELECT doc_id, score / (SELECT max(score) FROM bm) AS score FROM bm WHERE score > 0)
SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, round(0.7 * (coalesce(v.score, 0) + 1) / 2 + 0.3 * coalesce(b.score, 0), 6) AS score FROM v FULL JOIN b ON v.doc_id = b.doc_id ORDER BY 2 DESC, 1 LIMIT 20
""",
)
def k2_hybrid(spark, sf_dir):
    vectors = R.vector_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 200).withColumnRenamed("vec_id", "doc_id")
    # the scores are read twice, for their maximum and for the join, but the texts only once more
    words = R.max_normalised(settle(R.bm25(table(spark, sf_dir, "documents"), WORDS), "bm25"), "score")
    return R.top(R.fused(vectors, words, "doc_id"), "score", "doc_id", 20).select("doc_id", "score")


@query(
    "w4_min_max",
    f"WITH {_COSINE_SQL}, m AS (SELECT *, min(score) OVER (PARTITION BY label) AS lo, max(score) OVER (PARTITION BY label) AS hi FROM cos) SELECT vec_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score > 0 THEN 1.0 ELSE 0.0 END, 6) AS score FROM m",
)
def w4_min_max(spark, sf_dir):
    literal = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    scored = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(R.cosine(F.col("embedding"), literal), 6).alias("score"))
    return R.min_max(scored, "score", ["label"]).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "v9_boost",
    f"WITH {bm25_sql(WORDS)}, t AS (SELECT doc_id, list_transform(regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS title, lower(lang) AS kw FROM documents) "
    "SELECT doc_id, round(score + CASE WHEN list_has_any(title, ['the', 'license', 'of', 'haen', 'shed']) THEN 0.05 ELSE 0 END + CASE WHEN kw IN ('the', 'license', 'of', 'haen', 'shed') THEN 0.01 ELSE 0 END, 6) AS score FROM bm JOIN t USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 5",
)
def v9_boost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    titles = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "lang")
    hits = R.bm25(docs, WORDS).join(titles, "doc_id")
    return R.top(R.boosted(hits, WORDS, "title", "lang"), "score", "doc_id", 5).select("doc_id", "score")


@query("v2_hash_embedding")
def v2_hash_embedding(spark, sf_dir):
    """blake2b isn't in SQL; tests compare it with hashlib."""
    return embedded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("w15_chunks")
def w15_chunks(spark, sf_dir):
    """Greedy packing isn't a framed sum; tests check budgets and that no word is lost."""
    return chunked(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "w10_rounds",
    "WITH r AS (SELECT conv_id, turn, text, count_if(role = 'user' AND trim(text) <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations) SELECT conv_id, segment, count(*) AS turns, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS estimate FROM r GROUP BY ALL",
)
def w10_rounds(spark, sf_dir):
    cut = C.rounds(table(spark, sf_dir, "conversations"))
    return cut.groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.sum(char_estimate("text")).alias("estimate"))


@query(
    "w12_without_oldest",
    "WITH r AS (SELECT conv_id, turn, count_if(role = 'user' AND trim(text) <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations), m AS (SELECT *, max(segment) OVER (PARTITION BY conv_id) AS n FROM r) SELECT conv_id, turn FROM m WHERE segment > least(greatest(1, n // 5), n - 1)",
)
def w12_without_oldest(spark, sf_dir):
    return C.without_oldest(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query(
    "c4_microcompact",
    "WITH r AS (SELECT *, role = 'assistant' AND length(text) >= 40 AS e FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, e ORDER BY turn DESC) AS n FROM r) "
    "SELECT conv_id, turn, CASE WHEN e AND n > 2 THEN '[cleared]' ELSE text END AS text, CASE WHEN e AND n > 2 THEN greatest(0, (length(text) + 3) // 4 - 3) ELSE 0 END AS saved FROM k",
)
def c4_microcompact(spark, sf_dir):
    out = C.microcompacted(table(spark, sf_dir, "conversations"), (F.col("role") == "assistant") & (F.length("text") >= 40), keep=2)
    return out.select("conv_id", "turn", "text", F.col("saved").cast("long").alias("saved"))


@query(
    "c3_collapse",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, turn, CASE WHEN b > 2 AND length(text) > 120 THEN substr(text, 1, 60) || chr(10) || '...' || chr(10) || right(text, 30) ELSE text END AS text FROM r",
)
def c3_collapse(spark, sf_dir):
    return C.collapsed(table(spark, sf_dir, "conversations"), recent=2, limit=120, head=60, tail=30).select("conv_id", "turn", "text")


@query(
    "c5_summary",
    r"""
WITH f AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE trim(text) <> ''),
l AS (SELECT conv_id, turn, role || ': ' || CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS line FROM f),
s AS (SELECT *, row_number() OVER w AS no, sum(length(line) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, line FROM s WHERE no <= 48 AND used <= 4000
""",
)
def c5_summary(spark, sf_dir):
    return C.summary_lines(table(spark, sf_dir, "conversations"))


@query(
    "t12_threshold",
    "WITH r AS (SELECT conv_id, turn, sum((length(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM conversations) SELECT conv_id, min(turn) AS turn, CAST(min(total) AS BIGINT) AS total FROM r WHERE total >= 100 GROUP BY conv_id",
)
def t12_threshold(spark, sf_dir):
    return C.over_threshold(table(spark, sf_dir, "conversations"), 133, 33)


@query("c1_sanitized")
def c1_sanitized(spark, sf_dir):
    """Turns with calls made from their numbers; a sequential fold, which tests compare with cases by hand."""
    turns, none = table(spark, sf_dir, "conversations"), F.array().cast("array<string>")
    calls = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.array(F.col("turn").cast("string"))).otherwise(none)
    results = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.array((F.col("turn") - 1).cast("string"))).otherwise(none)
    return C.sanitized(turns.select("conv_id", "turn", "role", "text", calls.alias("calls"), results.alias("results")))


@query(
    "j12_pairs",
    "SELECT conv_id, turn, lead(turn) OVER w AS reply, length(lead(text) OVER w) AS reply_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user' AND lead(role) OVER w = 'assistant'",
)
def j12_pairs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("turn").over(w)).withColumn("reply_chars", F.length(F.lead("text").over(w)).cast("long"))
    return nxt.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "reply", "reply_chars")


@query(
    "k6_memory_top",
    """
WITH h AS (SELECT doc_id, len(list_filter(['the', 'license', 'haen', 'shed'], lambda t: contains(lower(split_part(text, chr(10), 1)), t))) AS meta, len(list_filter(['the', 'license', 'haen', 'shed'], lambda t: contains(lower(text), t))) AS body FROM documents)
SELECT doc_id, round((meta * 2.0 + body + coalesce(quality, 0) * 0.4)::DOUBLE, 6) AS score FROM h LEFT JOIN labels USING (doc_id) WHERE meta + body > 0 ORDER BY 2 DESC, 1 LIMIT 5
""",
)
def k6_memory_top(spark, sf_dir):
    terms = ["the", "license", "haen", "shed"]
    hits = lambda text: sum((F.when(F.lower(text).contains(t), 1).otherwise(0) for t in terms[1:]), F.when(F.lower(text).contains(terms[0]), 1).otherwise(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", hits(F.split_part("text", F.lit("\n"), F.lit(1))).alias("meta"), hits(F.col("text")).alias("body")).where("meta + body > 0")
    scored = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.top(scored.select("doc_id", F.round(F.col("meta") * 2.0 + F.col("body") + F.coalesce("quality", F.lit(0)) * 0.4, 6).alias("score")), "score", "doc_id", 5)


@query(
    "v18_priority",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN 60 WHEN 'purchase' THEN 55 ELSE 50 END + CASE WHEN event_type = 'error' AND value > 50 THEN 25 ELSE 0 END + greatest(0, 10 - date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')) AS score FROM events
""",
)
def v18_priority(spark, sf_dir):
    base = F.when(F.col("event_type") == "error", 60).when(F.col("event_type") == "purchase", 55).otherwise(50)
    urgent = F.when((F.col("event_type") == "error") & (F.col("value") > 50), 25).otherwise(0)
    recent = F.greatest(F.lit(0), 10 - F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")))
    return table(spark, sf_dir, "events").select("event_id", (base + urgent + recent).cast("long").alias("score"))
