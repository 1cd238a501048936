"""Queries on documents and pages: scans, tokens, clean-up and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.plans.registry import query
from lodestrata.runtime import table

_W = "[A-Za-z0-9_]+"
_CJK = X.CJK


@query(
    "x1_tokens",
    f"""
SELECT doc_id, len(regexp_extract_all(text, '{_W}')) + len(regexp_extract_all(text, '{_CJK}')) AS token_estimate,
       (length(text) + 3) // 4 AS char_estimate,
       sha256(array_to_string(list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x)), ' ')) AS tokens_sha256,
       len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3))) AS n_terms
FROM documents
""",
)
def x1_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.token_estimate("text").cast("long").alias("token_estimate"), X.char_estimate("text").cast("long").alias("char_estimate"),
        F.sha2(F.array_join(X.tokens("text"), " "), 256).alias("tokens_sha256"), F.size(X.search_terms("text")).cast("long").alias("n_terms"),
    )


@query("x5_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha256(trim(source)), 1, 32) AS source_hash FROM documents")
def x5_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.content_hash("text").alias("content_hash"), X.content_hash(X.strip("source"), 32).alias("source_hash"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "x7_normalized",
    rf"""
WITH n AS (SELECT doc_id, {_STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS t
FROM documents)
SELECT doc_id, sha256(t) AS text_sha256, length(t) AS n_chars FROM n
""",
)
def x7_normalized(spark, sf_dir):
    done = table(spark, sf_dir, "documents").select("doc_id", X.normalized("text").alias("t"))
    return done.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


@query(
    "x11_titles",
    rf"""
SELECT doc_id, substr({_STRIP.format(r"regexp_replace(regexp_extract(text, '^\s*([^\n]*)', 1), '^[#\s*>-]+', '')")}, 1, 80) AS title,
       CASE WHEN length(f) > 160 THEN substr(f, 1, 157) || '...' ELSE f END AS excerpt
FROM (SELECT *, {_STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS f FROM documents)
""",
)
def x11_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.title("text").alias("title"), X.excerpt("text").alias("excerpt"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "x39_secrets",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN '{n}' END" for n, p in X.SECRET_RULES)
    + "], lambda x: x IS NOT NULL), ',') AS rules FROM documents",
)
def x39_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.secrets("text"), ",").alias("rules"))


_FACT_SQL = " UNION ALL ".join(
    rf"SELECT doc_id, '{n}' AS type, regexp_replace({_STRIP.format('v')}, '[.,;:)]+$', '') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(p)}, 1)) AS v FROM documents)"
    for n, p in X.FACT_PATTERNS
)


@query(
    "x38_facts",
    rf"""
SELECT type, value, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM ({_FACT_SQL})
WHERE length(value) >= 3 AND NOT (type = 'ip_address' AND regexp_matches(value, '^(0\.|255\.|127\.0\.0\.1)')) GROUP BY type, value
""",
)
def x38_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.facts("text")).alias("f")).select("doc_id", "f.*")
    return rows.groupBy("type", "value").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(
    "d4_signatures",
    rf"""
WITH s AS (
  SELECT doc_id, sha256(lang || chr(10) || {_STRIP.format(r"regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')")}) AS signature
  FROM documents
) SELECT signature, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY signature
""",
)
def d4_signatures(spark, sf_dir):
    signed = table(spark, sf_dir, "documents").select("doc_id", X.signature("lang", "text").alias("signature"))
    return signed.groupBy("signature").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "d5_fingerprints",
    """
SELECT page_id, lower(substr(url, 1, 5)) || ':' || substr(sha1(CASE WHEN page_id % 2 = 0 THEN trim(url) ELSE trim(url) || chr(10) || page_id END), 1, 16) AS fingerprint
FROM pages
""",
)
def d5_fingerprints(spark, sf_dir):
    ref = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("")
    kind = F.lower(F.substr("url", F.lit(1), F.lit(5)))
    return table(spark, sf_dir, "pages").select("page_id", X.fingerprint(kind, ref, "url", F.col("page_id").cast("string")).alias("fingerprint"))


@query(
    "x54_page_text",
    rf"""
SELECT page_id, sha256(f) AS flat_sha256, length(f) AS n_chars
FROM (SELECT page_id, {_STRIP.format(r"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")} AS f FROM pages)
""",
)
def x54_page_text(spark, sf_dir):
    flat = table(spark, sf_dir, "pages").select("page_id", X.without_tags("html").alias("f"))
    return flat.select("page_id", F.sha2("f", 256).alias("flat_sha256"), F.length("f").cast("long").alias("n_chars"))


def _unescape_sql(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


@query(
    "s3_html_lines",
    rf"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', chr(10), 'g') AS h FROM pages),
l AS (
  SELECT page_id, list_filter(list_transform(string_split(regexp_replace(h, '<[^>]+>', chr(10), 'g'), chr(10)),
         lambda x: {_STRIP.format(_unescape_sql('x'))}), lambda x: x <> '') AS lines FROM b
) SELECT page_id, len(lines) AS n_lines, sha256(array_to_string(lines, chr(10))) AS text_sha256 FROM l
""",
)
def s3_html_lines(spark, sf_dir):
    done = table(spark, sf_dir, "pages").select("page_id", X.html_text("html").alias("t"))
    n = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("long")
    return done.select("page_id", n.alias("n_lines"), F.sha2("t", 256).alias("text_sha256"))


@query(
    "s12_scripts",
    r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages)
SELECT page_id, count(*) AS n_scripts, CAST(sum(length(body)) AS BIGINT) AS script_chars, count_if(json_valid(trim(body))) AS n_json FROM s GROUP BY page_id
""",
)
def s12_scripts(spark, sf_dir):
    bodies = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("body"))
    return bodies.groupBy("page_id").agg(F.count("*").alias("n_scripts"), F.sum(F.length("body")).alias("script_chars"), F.count_if(F.try_parse_json(F.trim("body")).isNotNull()).alias("n_json"))


@query(
    "s15_links",
    r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM a GROUP BY href
""",
)
def s15_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s+[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(
    "s14_blocks",
    r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(p|li)\b[^>]*>(.*?)</', 2)) AS inner_html FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(inner_html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS body FROM b)
SELECT page_id, count(*) AS n_blocks, CAST(sum(length(body)) AS BIGINT) AS n_chars, max(length(body)) AS longest FROM t WHERE body <> '' GROUP BY page_id
""",
)
def s14_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(p|li)\b[^>]*>(.*?)</"), F.lit(2))).alias("b"))
    flat = blocks.select("page_id", X.without_tags("b").alias("body")).where("body <> ''")
    return flat.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("body")).alias("n_chars"), F.max(F.length("body")).cast("long").alias("longest"))


@query(
    "x16_urls",
    r"""
WITH u AS (SELECT page_id, url, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1) AS host
FROM pages),
r AS (
  SELECT *, CASE WHEN scheme <> 'https' THEN 'scheme'
    WHEN NOT (host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org') THEN 'domain'
    WHEN regexp_matches(url, '(?i)[?&](token|secret|password|api[_-]?key|access[_-]?token|signature)=') THEN 'secret' END AS reason FROM u
)
SELECT page_id, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN regexp_replace(url, '#.*$', '') END AS url, reason FROM r
""",
)
def x16_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.https_url("url", ["example.com", "example.org"]).alias("u")).select("page_id", "u.ok", "u.url", "u.reason")


@query(
    "s28_grep",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)
SELECT doc_id, no AS line_no, line FROM l WHERE regexp_matches(line, '(?i)licen[sc]e|token\s*=')
""",
)
def s28_grep(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?i)licen[sc]e|token\s*=")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.col("line").rlike(r"(?i)licen[sc]e|token\s*=")).select("doc_id", (F.col("no") + 1).cast("long").alias("line_no"), "line")


@query("s29_glob", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?s)^[!-z]*a.*$') AND NOT regexp_matches(p_brand, '^Brand.[1]')")
def s29_glob(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_name").rlike(r"(?s)^[!-z]*a.*$") & ~F.col("p_brand").rlike(X.glob_pattern("Brand?[1]*"))).select("p_partkey", "p_name")


@query(
    "x24_salaries",
    r"""
WITH t AS (SELECT p_partkey, p_size AS lo, p_size + 10 AS hi, 12 + p_partkey % 10 AS m, p_partkey % 4 AS form FROM part),
v AS (
  SELECT p_partkey, CASE form WHEN 0 THEN lo * 1000.0 WHEN 1 THEN lo * 10000.0 / 12 WHEN 2 THEN lo * 1000.0 + 1000 ELSE lo * 1000.0 END AS low,
         CASE form WHEN 0 THEN hi * 1000.0 WHEN 1 THEN hi * 10000.0 / 12 WHEN 2 THEN hi * 1000.0 + 1000 ELSE lo * 1000.0 END AS high,
         CASE WHEN form = 0 AND m BETWEEN 12 AND 20 THEN m ELSE 12 END AS months FROM t
)
SELECT p_partkey, CASE WHEN round_even(low, 0) BETWEEN 800 AND 500000 AND round_even(high, 0) BETWEEN 800 AND 500000 THEN CAST(round_even(low, 0) AS INT) END AS low,
       CASE WHEN round_even(low, 0) BETWEEN 800 AND 500000 AND round_even(high, 0) BETWEEN 800 AND 500000 THEN CAST(round_even(high, 0) AS INT) END AS high,
       CASE WHEN round_even(low, 0) BETWEEN 800 AND 500000 AND round_even(high, 0) BETWEEN 800 AND 500000 THEN CAST(months AS INT) END AS months FROM v
""",
)
def x24_salaries(spark, sf_dir):
    lo, hi, form = F.col("p_size"), F.col("p_size") + 10, F.col("p_partkey") % 4
    stated = (
        F.when(form == 0, F.concat(lo, F.lit("-"), hi, F.lit("K·"), 12 + F.col("p_partkey") % 10, F.lit("薪")))
        .when(form == 1, F.concat(lo, F.lit("-"), hi, F.lit("万/年")))
        .when(form == 2, F.concat(lo * 1000 + 1000, F.lit("-"), hi * 1000 + 1000, F.lit("元")))
        .otherwise(F.concat(lo, F.lit("K以上")))
    )
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", X.salary(stated).alias("s")).select("p_partkey", "s.*")


@query(
    "x25_experience",
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 9) || '-' || (o_custkey % 9 + 2) || '年' WHEN 1 THEN (o_custkey % 9) || '年以上' WHEN 2 THEN '不限' ELSE '应届' END AS experience,
       CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 9)::DOUBLE WHEN 1 THEN (o_custkey % 9)::DOUBLE ELSE 0.0 END AS low,
       CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 9 + 2)::DOUBLE WHEN 3 THEN 1.0 ELSE 99.0 END AS high FROM orders
""",
)
def x25_experience(spark, sf_dir):
    form, years = F.col("o_orderkey") % 4, F.col("o_custkey") % 9
    stated = F.when(form == 0, F.concat(years, F.lit(" - "), years + 2, F.lit("年经验"))).when(form == 1, F.concat(years, F.lit("年以上经验"))).when(form == 2, F.lit("经验不限")).otherwise(F.lit("应届生"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", X.experience(stated).alias("experience"))
    return found.select("o_orderkey", "experience", X.experience_bounds("experience").alias("b")).select("o_orderkey", "experience", "b.low", "b.high")


@query(
    "x50_session_keys",
    """
WITH k AS (
  SELECT event_type || ':' || (user_id % 7) || CASE WHEN event_id % 3 = 0 THEN ':' || (event_id % 5) || ':' || user_id WHEN event_id % 3 = 1 THEN ':' || user_id ELSE '' END AS session_key, event_id
  FROM events
) SELECT session_key, count(*) AS n, min(event_id) AS first_event FROM k GROUP BY session_key
""",
)
def x50_session_keys(spark, sf_dir):
    events, text = table(spark, sf_dir, "events"), lambda c: c.cast("string")
    thread = F.when(F.col("event_id") % 3 == 0, text(F.col("event_id") % 5))
    key = X.session_key("event_type", text(F.col("user_id")), text(F.col("user_id") % 7), thread, shared=F.col("event_id") % 3 == 1)
    return events.groupBy(key.alias("session_key")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "x12_metadata",
    r"""
SELECT doc_id, coalesce(source, 'unknown') AS source, CASE WHEN lang IN ('en', 'de') THEN 'germanic' ELSE 'other' END AS family, length(text) AS char_count,
       array_to_string(list_filter([CASE WHEN source = '' THEN 'source' END, CASE WHEN length(text) <> n_chars THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS problems
FROM documents
""",
)
def x12_metadata(spark, sf_dir):
    problems = F.array_compact(F.array(F.when(F.col("source") == "", "source"), F.when(F.length("text") != F.col("n_chars"), "n_chars")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.when(F.col("lang").isin("en", "de"), "germanic").otherwise("other").alias("family"),
        F.length("text").cast("long").alias("char_count"), F.array_join(problems, ",").alias("problems"),
    )


@query(
    "x19_json_props",
    """
SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count_if(json_extract_string(props, '$.k') IS NULL) AS missing
FROM events GROUP BY event_type
""",
)
def x19_json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.try_cast("long")).alias("total"), F.count_if(k.isNull()).alias("missing"))


@query(
    "x52_questions",
    r"""
WITH p AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\n.;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0 AND regexp_matches(lower(x), 'wh|\?'))) AS q
FROM conversations WHERE role = 'user')
SELECT conv_id, turn, count(*) AS n, min(q) AS least FROM p GROUP BY conv_id, turn
""",
)
def x52_questions(spark, sf_dir):
    parts = F.filter(F.transform(F.split("text", r"[\n.;]"), X.strip), lambda x: (F.length(x) > 0) & F.lower(x).rlike(r"wh|\?"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(parts).alias("q"))
    return asked.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("q").alias("least"))
