"""Queries that read records out of texts, tags and tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.functions import text as X
from lodestrata.operators import scoring as S
from lodestrata.operators import windows as N
from lodestrata.plans.registry import query
from lodestrata.runtime import spread, table
from lodestrata.sources.ingest import json_texts

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NAMES = {"article": ["the", "der", "la"], "joint": ["and", "und", "et"], "licence": ["license", "licence"], "of": ["of", "de"], "tagged": ["c++", "#tag"]}
WORDS = ["license", "token", "The", "ation", "zzz"]


def _place_sql(alias: str) -> str:
    plain = alias.replace("+", r"\+")
    head = rf"regexp_extract(t, '^(|(?s:.*?)[^a-z0-9+#]){plain}(?:[^a-z0-9+#]|$)', 1)"
    return rf"CASE WHEN regexp_matches(t, '(^|[^a-z0-9+#]){plain}([^a-z0-9+#]|$)') THEN length({head}) + 1 END"


def _names_sql(column: str = "t") -> str:
    rows = ", ".join(f"{{'at': least({', '.join(_place_sql(a) for a in aliases)}), 'name': '{name}'}}" for name, aliases in NAMES.items())
    return f"list_transform(list_sort(list_filter([{rows}], lambda x: x.at IS NOT NULL)), lambda x: x.name)".replace("(t,", f"({column},")


@query("x21_names", f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, array_to_string({_names_sql()}, ',') AS names FROM d")
def x21_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.found_names("text", NAMES), ",").alias("names"))


_WORDS_SQL = ", ".join(f"{{'at': nullif(instr(t, '{w.lower()}'), 0), 'name': '{w}'}}" for w in WORDS)


@query(
    "x22_words",
    f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([{_WORDS_SQL}], lambda x: x.at IS NOT NULL)), lambda x: x.name), ',') AS words FROM d
""",
)
def x22_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.found_words("text", WORDS), ",").alias("words"))


@query(
    "x23_canonical",
    """
SELECT p_partkey, CASE WHEN lower(trim(p_type)) = 'small' OR regexp_matches(lower(p_type), '(^|[^a-z0-9+#])(small|economy)([^a-z0-9+#]|$)') THEN 'small'
  WHEN lower(trim(p_type)) = 'large' OR regexp_matches(lower(p_type), '(^|[^a-z0-9+#])(large|standard)([^a-z0-9+#]|$)') THEN 'large' ELSE trim(p_type) END AS kind
  FROM part
""",
)
def x23_canonical(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.canonical("p_type", {"small": ["small", "economy"], "large": ["large", "standard"]}).alias("kind"))


_OWNED_SQL = """
owned AS (SELECT DISTINCT o_custkey AS c, p_brand AS brand FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
required AS (SELECT DISTINCT s_nationkey AS n, p_brand AS brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
families AS (SELECT DISTINCT c, substr(brand, 7, 1) AS family FROM owned),
states AS (
  SELECT c_custkey, r.brand, CASE WHEN o.c IS NOT NULL THEN 'covered' WHEN f.c IS NOT NULL THEN 'partial' ELSE 'missing' END AS state
  FROM customer JOIN required r ON r.n = c_nationkey LEFT JOIN owned o ON o.c = c_custkey AND o.brand = r.brand
  LEFT JOIN families f ON f.c = c_custkey AND f.family = substr(r.brand, 7, 1)
)
"""


def _coverage(spark, sf_dir):
    """What each customer has of the brands that suppliers of its nation sell: the brand, one of its family, or neither."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    brands = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    owned = brands.join(orders, "l_orderkey").select("c_custkey", "brand").distinct()
    required = brands.join(suppliers, "l_suppkey").select("c_nationkey", "brand").distinct()
    wanted = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(required, "c_nationkey").select("c_custkey", "brand")
    return S.related(wanted, owned, ["c_custkey"], "brand", F.substr("brand", F.lit(7), F.lit(1)))


@query("j10_related", f"WITH {_OWNED_SQL} SELECT c_custkey, brand, state FROM states")
def j10_related(spark, sf_dir):
    return _coverage(spark, sf_dir).select("c_custkey", "brand", "state")


@query(
    "v14_coverage",
    f"""
WITH {_OWNED_SQL}
SELECT c_custkey, round(sum(CASE state WHEN 'covered' THEN 1 WHEN 'partial' THEN 0.6 ELSE 0 END) / count(*), 6) AS coverage,
       count_if(state = 'covered')::BIGINT AS covered, count_if(state = 'partial')::BIGINT AS partial, count_if(state = 'missing')::BIGINT AS missing
       FROM states GROUP BY c_custkey
""",
)
def v14_coverage(spark, sf_dir):
    weight = F.when(F.col("state") == "covered", 1.0).when(F.col("state") == "partial", 0.6).otherwise(0.0)
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("covered", "partial", "missing")]
    return _coverage(spark, sf_dir).groupBy("c_custkey").agg(F.round(F.sum(weight) / F.count("*"), 6).alias("coverage"), *counts)


def _external_sql(column: str, chars: int) -> str:
    bare = f"regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in P.HIDDEN:
        bare = rf"regexp_replace({bare}, '(?is)<{tag}\b([^>]*[^/>])?>.*?</{tag}\s*>', ' ', 'g')"
    for tag in P.HIDDEN:
        bare = rf"regexp_replace({bare}, '(?is)<{tag}\b([^>]*[^/>])?>.*', ' ')"
    bare = f"regexp_replace({bare}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    bare = rf"regexp_replace(regexp_replace({bare}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t]+', ' ', 'g')"
    return f"substr({_STRIP.format(bare)}, 1, {chars})"


@query("x15_external", f"SELECT page_id, sha256(t) AS text_sha256, length(t) AS n_chars FROM (SELECT page_id, {_external_sql('html', 50000)} AS t FROM pages)")
def x15_external(spark, sf_dir):
    text = table(spark, sf_dir, "pages").select("page_id", P.external_text("html", 50_000).alias("t"))
    return text.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


@query(
    "x15_nested",
    f"SELECT page_id, CASE WHEN page_id % 50 = 0 THEN sha256(t) ELSE sha256('tail') END AS text_sha256 FROM (SELECT page_id, {_external_sql("(html || '<p>tail</p>')", 50000)} AS t FROM pages)",
)
def x15_nested(spark, sf_dir):
    """Pages within up to 49 hidden elements, and a paragraph behind them."""
    kinds = F.element_at(F.array(F.lit("form"), F.lit("object"), F.lit("template")), (F.col("page_id") % 3 + 1).cast("int"))
    deep = (F.col("page_id") % 50).cast("int")
    wrapped = F.concat(F.repeat(F.concat(F.lit("<"), kinds, F.lit(" a='>'>")), deep), F.when(deep == 0, F.col("html")).otherwise(F.regexp_replace("html", "(?i)</?(form|object|template|embed)[^>]*>", "")), F.repeat(F.concat(F.lit("</"), kinds, F.lit(">")), deep), F.lit("<p>tail</p>"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(P.external_text(wrapped, 50_000), 256).alias("text_sha256"))


@query(
    "x13_digests",
    """
WITH j AS (
  SELECT doc_id, '{"lang": ' || to_json(lang) || ', "n_chars": "' || n_chars || '", "source": ' || to_json(source) || '}' AS meta FROM documents
) SELECT doc_id, meta, substr(sha256(meta), 1, 20) AS digest FROM j
""",
)
def x13_digests(spark, sf_dir):
    fields = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", P.stable_json(fields).alias("meta"), P.metadata_digest(fields).alias("digest"))


@query(
    "x14_metadata",
    """
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 1 ELSE 2 END AS n_fields, CASE WHEN l.quality IS NULL THEN '{"lang": ' || to_json(lang) || '}'
       ELSE '{"lang": ' || to_json(lang) || ', "quality": "' || l.quality || '"}' END AS meta FROM documents d LEFT JOIN labels l USING (doc_id)
""",
)
def x14_metadata(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = P.scalar_metadata(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("lang"), "lang"))
    return both.select("doc_id", F.size(fields).alias("n_fields"), P.stable_json(fields).alias("meta"))


_RAW = {"id": ["provider_record_id", "job_id", "id"], "title": ["title", "jobName", "name"], "company": ["company", "brandName"], "city": ["city", "workCity"]}


def _raw_records(spark, sf_dir):
    """Records of parts as a provider might send them: with other names of keys, and some without a name."""
    form = F.col("p_partkey") % 3
    title = F.when(F.col("p_size") > 3, F.concat(F.lit("<b>"), "p_name", F.lit("</b>")))
    alike = [F.struct(F.col("p_partkey").cast("string").alias(a), title.alias(b), F.col("p_brand").alias(c), F.col("p_type").alias(d)) for a, b, c, d in (("id", "name", "company", "city"), ("job_id", "jobName", "brandName", "workCity"), ("provider_record_id", "title", "company", "workCity"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.when(form == 0, F.to_json(alike[0])).when(form == 1, F.to_json(alike[1])).otherwise(F.to_json(alike[2])).alias("raw"))


def _normalised(spark, sf_dir):
    given = F.struct(*(P.external_text(P.first_given("raw", keys), 200).alias(name) for name, keys in _RAW.items()))
    rows = spread(_raw_records(spark, sf_dir)).select("*", F.inline(F.array(given)))  # filters don't repeat what a generator makes
    reason = F.when(F.col("id") == "", "id").when(F.col("title") == "", "title").when(F.col("company") == "", "company")
    return rows.withColumn("reason", reason)


@query(
    "x17_records",
    r"""
SELECT 'job:parts:' || p_partkey AS id, regexp_replace(p_name, '[ \t]+', ' ', 'g') AS title, p_brand AS company, p_type AS city,
       substr(sha256(regexp_replace(p_name, '[ \t]+', ' ', 'g') || chr(10) || p_brand || chr(10) || p_type), 1, 32) AS content_hash FROM part WHERE p_size > 3
""",
)
def x17_records(spark, sf_dir):
    good = _normalised(spark, sf_dir).where("reason IS NULL")
    seed = F.concat_ws("\n", "title", "company", "city")
    return good.select(F.concat(F.lit("job:parts:"), "id").alias("id"), "title", "company", "city", X.content_hash(seed, 32).alias("content_hash"))


@query("x17_rejected", "SELECT CASE WHEN p_size <= 3 THEN 'title' END AS reason, count(*) AS n, min(p_partkey) AS first_key FROM part WHERE p_size <= 3 GROUP BY 1")
def x17_rejected(spark, sf_dir):
    bad = _normalised(spark, sf_dir).where("reason IS NOT NULL")
    return bad.groupBy("reason").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query(
    "x20_company_keys",
    r"""
WITH k AS (SELECT c_custkey, lower(regexp_replace(c_name, '\s+', '', 'g')) AS key FROM customer)
SELECT c_custkey, key, 'company:' || substr(regexp_replace(regexp_replace(key, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72) AS id FROM k
""",
)
def x20_company_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey", P.company_key("c_name").alias("key"))
    return keys.select("c_custkey", "key", P.company_id("key").alias("id"))


@query(
    "x27_periods",
    """
WITH o AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN year(a) BETWEEN 2000 AND 2099 THEN strftime(a, '%Y.%m') || '-' || strftime(b, '%Y.%m') END AS period,
       CASE WHEN year(a) BETWEEN 2000 AND 2099 THEN round(year(b) + (month(b) - 1) / 12.0 - year(a) - (month(a) - 1) / 12.0, 1) END AS years FROM o
""",
)
def x27_periods(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    told = F.concat(F.lit("worked "), F.date_format("a", "yyyy.MM"), F.lit(" — "), F.date_format("b", "yyyy.MM"), F.lit(" there"))
    found = ends.select("o_custkey", F.get(P.periods(told), F.lit(0)).alias("period"))
    return found.select("o_custkey", "period", F.round(P.period_years("period", F.lit(dt.date(2024, 2, 1))), 1).alias("years"))


@query(
    "x29_contacts",
    rf"""
SELECT doc_id, nullif(regexp_extract(text, '{P.EMAIL}'), '') AS email, nullif(regexp_replace(regexp_extract(text, 'https?://\S+'), '[。，,;；]+$', ''), '') AS website
FROM documents
""",
)
def x29_contacts(spark, sf_dir):
    found = P.contact("text", ["北京", "上海"])
    return table(spark, sf_dir, "documents").select("doc_id", found["email"].alias("email"), found["website"].alias("website"))


_MARKED_SQL = "array_to_string(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'license')), chr(10))"


@query(
    "x33_posting",
    f"""
WITH d AS (SELECT doc_id, lower(text) AS t, {_MARKED_SQL} AS m, lang FROM documents), n AS (SELECT doc_id, {_names_sql()} AS every, {_names_sql("m")} AS wanted, lang
FROM d)
SELECT doc_id, lang AS title, array_to_string(list_filter(every, lambda x: NOT list_contains(wanted, x)), ',') AS required,
       array_to_string(list_filter(every, lambda x: list_contains(wanted, x)), ',') AS preferred FROM n
""",
)
def x33_posting(spark, sf_dir):
    told = table(spark, sf_dir, "documents").select("doc_id", P.posting("text", NAMES, ["Berlin"], ["license"], title=F.col("lang")).alias("p"))
    return told.select("doc_id", "p.title", F.array_join("p.required", ",").alias("required"), F.array_join("p.preferred", ",").alias("preferred"))


_CODE = {"markup": [r"<\w+", "</"], "code": [r"\bvar\b", r"\bfunction\b", "=>"], "style": [r"\bcolor\s*:", r"\bmargin\b"]}
_CODE_SQL = ", ".join(
    "{'hits': " + " + ".join(f"CAST(regexp_matches(html, '{p}') AS INT)" for p in patterns) + f", 'o': {-i}, 'name': '{name}'}}" for i, (name, patterns) in enumerate(_CODE.items())
)


@query("x35_languages", f"WITH h AS (SELECT page_id, list_sort([{_CODE_SQL}], 'DESC')[1] AS best FROM pages) SELECT page_id, CASE WHEN best.hits > 0 THEN best.name ELSE '' END AS language FROM h")
def x35_languages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.code_language("html", _CODE).alias("language"))


@query(
    "x37_topics",
    """
WITH h AS (SELECT doc_id, list_filter(['license', 'token', 'email'], lambda w: contains(lower(text), w)) AS hits FROM documents)
SELECT doc_id, array_to_string(hits, ',') AS keywords, CASE WHEN len(hits) > 0 THEN 'legal' ELSE '' END AS topic FROM h
""",
)
def x37_topics(spark, sf_dir):
    words = F.array(*map(F.lit, ["license", "token", "email"]))
    hits = F.filter(words, lambda w: F.contains(F.lower("text"), w))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(hits, ",").alias("keywords"), F.when(F.size(hits) > 0, "legal").otherwise("").alias("topic"))


@query("x4_message_tokens", "SELECT conv_id, CAST(floor(sum((length(coalesce(text, '')) + 3) // 4) * 4 / 3.0) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def x4_message_tokens(spark, sf_dir):
    total = F.sum(X.char_estimate("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.floor(total * 4 / F.lit(3.0)).alias("tokens"))


_CUT_SQL = "coalesce(" + ", ".join(f"try(decode(encode(h)[1:{n}]))" for n in (400, 399, 398, 397)) + ")"


@query(
    "x43_bounded",
    rf"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, len(lines) AS n, array_to_string(lines[1:5], chr(10)) AS h FROM l),
c AS (SELECT *, octet_length(encode(h)) > 400 AS long, {_CUT_SQL} AS cut FROM h)
SELECT doc_id, CASE WHEN long THEN CASE WHEN contains(cut, chr(10)) AND NOT starts_with(cut, chr(10)) THEN regexp_replace(cut, '(?s)\n[^\n]*$', '') ELSE cut END ELSE h END AS text, long OR n > 5 AS truncated
FROM c
""",
)
def x43_bounded(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", P.bounded_text("text", 5, 400).alias("b"))
    return cut.select("doc_id", "b.text", "b.truncated")


@query(
    "x47_bars",
    """
SELECT p_partkey, '[' || repeat('#', round_even(s / 100 * 18, 0)::INT) || repeat('-', 18 - round_even(s / 100 * 18, 0)::INT) || '] ' || printf('%5.1f', s) AS bar, round_even(p_retailprice / 1000, 0)::BIGINT || '-' || round_even(2 * p_retailprice / 1000, 0)::BIGINT || 'K' || CASE WHEN p_size % 24 IN (0, 12) THEN '' ELSE '·' || p_size % 24 || '薪' END AS pay
FROM (SELECT *, least(100.0, p_size::DOUBLE * 2) AS s FROM part)
""",
)
def x47_bars(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", P.score_bar(F.col("p_size").cast("double") * 2).alias("bar"), P.thousands("p_retailprice", F.col("p_retailprice") * 2, F.col("p_size") % 24).alias("pay"))


@query(
    "x53_record_texts",
    """
SELECT p_partkey, trim('Title: ' || p_name || chr(10) || 'Company: ' || p_brand || chr(10) || 'Size: ' || p_size || chr(10) || chr(10) || p_type) AS text,
       'job:' || lower(p_brand) || ':' || p_partkey AS doc_id FROM part
""",
)
def x53_record_texts(spark, sf_dir):
    text = P.record_text([("Title", "p_name"), ("Company", "p_brand"), ("Size", "p_size")], "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.concat(F.lit("job:"), F.lower("p_brand"), F.lit(":"), F.col("p_partkey").cast("string")).alias("doc_id"))


@query(
    "x55_mentions",
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(CAST(user_id AS VARCHAR)) AS least FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY event_type",
)
def x55_mentions(spark, sf_dir):
    """Every event's properties with a list of mentions, read back and counted."""
    user = F.col("user_id").cast("string")
    value = F.concat(F.lit('[{"id": "'), user, F.lit('"}, " ", {"other": 1}]'))
    rows = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isNotNull()).select("event_type", F.explode(P.mention_ids(value)).alias("id"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("users"), F.min("id").alias("least"))


@query(
    "x56_paths",
    rf"""
WITH l AS (SELECT conv_id, turn, unnest(list_filter(string_split({_STRIP.format("text")}, chr(10)), lambda x: {_STRIP.format("x")} <> '')) AS x
FROM conversations WHERE NOT regexp_matches({_STRIP.format("text")}, '^[\[{{]'))
SELECT conv_id, turn, count(*) AS n, min({_STRIP.format("regexp_replace(x, '^[- ]+|[- ]+$', '', 'g')")}) AS least FROM l GROUP BY conv_id, turn
""",
)
def x56_paths(spark, sf_dir):
    plain = table(spark, sf_dir, "conversations").where(~X.strip("text").rlike(r"^[\[{]"))
    rows = plain.select("conv_id", "turn", F.explode(P.selected_paths("text")).alias("path"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("path").alias("least"))


@query(
    "x59_urls",
    r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host
FROM pages)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN regexp_matches(host, '^(10|127)\.|^192\.168\.') THEN 'address'
       WHEN host = 'localhost' OR regexp_matches(host, '\.(local|internal)$') THEN 'local' WHEN NOT contains(host, '.') THEN 'label' END AS problem FROM u
""",
)
def x59_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.url_problem("url").alias("problem"))


_SECTIONS = ["basic", "skills", "education", "experience"]


@query(
    "x61_visibility",
    """
WITH h AS (SELECT c_custkey, list_filter([CASE WHEN c_name <> '' THEN 'basic' END, CASE WHEN c_acctbal > 0 THEN 'skills' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'experience' END], lambda x: x IS NOT NULL) AS held
FROM customer),
i AS (SELECT c_custkey, list_filter(['basic', 'skills', 'education', 'experience'], lambda s: s <> 'education' AND list_contains(held, s)) AS inc FROM h)
SELECT c_custkey, array_to_string(inc, ',') AS included, array_to_string(list_filter(['basic', 'skills', 'education', 'experience'], lambda s: NOT list_contains(inc, s)), ',') AS excluded
FROM i
""",
)
def x61_visibility(spark, sf_dir):
    held = F.array_compact(F.array(F.when(F.col("c_name") != "", "basic"), F.when(F.col("c_acctbal") > 0, "skills"), F.when(F.col("c_mktsegment") == "BUILDING", "experience")))
    told = P.visible_sections(held, F.array(*map(F.lit, ["basic", "skills", "experience", "other"])), _SECTIONS)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(told["included"], ",").alias("included"), F.array_join(told["excluded"], ",").alias("excluded"))


@query("v5_models", "SELECT label, count(*) AS n, 'd' || min(len(embedding)) AS stored, bool_and(len(embedding) = 64) AS matches FROM embeddings GROUP BY label")
def v5_models(spark, sf_dir):
    """Collections whose vectors are of another model than the one in use must not be searched."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    return rows.select("label", "n", F.concat(F.lit("d"), F.col("least").cast("string")).alias("stored"), ((F.col("least") == 64) & (F.col("most") == 64)).alias("matches"))


@query(
    "v11_formatted",
    """
WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5)
SELECT lang, 'Found ' || count(*) || ' documents:' || chr(10) || string_agg('[' || rank || '] id=' || doc_id || ' score=' || printf('%.3f', n_chars / 1000.0), chr(10)
ORDER BY rank) AS answer FROM r GROUP BY lang
""",
)
def v11_formatted(spark, sf_dir):
    best = N.latest(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 5)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] id="), F.col("doc_id").cast("string"), F.lit(" score="), F.format_string("%.3f", F.col("n_chars") / 1000))
    told = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("hits"))
    head = F.concat(F.lit("Found "), F.size("hits").cast("string"), F.lit(" documents:"))
    return told.select("lang", F.concat_ws("\n", head, F.transform("hits", lambda h: h["line"])).alias("answer"))


ROUTES = {"expert": ["small", "brass"], "lead": ["large", "steel", "plated"]}


def _route_sql(words: list[str]) -> str:
    each = [f"CASE WHEN contains(lower(p_type), '{w}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_name), '{w}') THEN 8 WHEN contains(lower(p_brand), '{w}') THEN 3 ELSE 0 END" for w in words]
    return f"greatest(0, least(100, 50 + {' + '.join(each)}))"


@query("v19_route_fit", " UNION ALL ".join(f"SELECT p_partkey, '{r}' AS route, {_route_sql(w)} AS fit FROM part" for r, w in ROUTES.items()))
def v19_route_fit(spark, sf_dir):
    fits = P.route_fit(F.col("p_type"), F.col("p_name"), F.col("p_brand"), ROUTES)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(fits).alias("f")).select("p_partkey", "f.route", "f.fit")


@query(
    "v20_candidates",
    """
WITH h AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS skills, count(DISTINCT year(o_orderdate)) AS years
FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name AS name, n_name AS city, coalesce(skills, '') AS skills, coalesce(years, 0) AS years
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN h ON o_custkey = c_custkey
""",
)
def v20_candidates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.year("o_orderdate").alias("year"))
    had = orders.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("skills"), F.count_distinct("year").alias("years"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.join(had, "c_custkey", "left").select("c_custkey", F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.coalesce("skills", F.lit("")).alias("skills"), F.coalesce("years", F.lit(0)).alias("years"))


@query(
    "u19_filled",
    """
SELECT c_custkey, coalesce(nullif(c_name, ''), 'none') AS name, coalesce(n, 0) AS n_orders
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
""",
)
def u19_filled(spark, sf_dir):
    """Old settings fill only what the profile lacks."""
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    both = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(old, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce(F.when(F.col("c_name") != "", F.col("c_name")), F.lit("none")).alias("name"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("s2_json_text", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN props ELSE 'k: ' || json_extract_string(props, '$.k') END AS text FROM events")
def s2_json_text(spark, sf_dir):
    return json_texts(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text")), "text")


@query(
    "x36_findings",
    r"""
SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '\bwhile\s+True\s*:') AND NOT contains(html, 'break') THEN 'endless_loop' END,
  CASE WHEN regexp_matches(html, '(^|[^=!<>])==([^=]|$)|(^|[^=!<>])!=([^=]|$)') THEN 'loose_equality' END], lambda x: x IS NOT NULL), ',') AS findings
  FROM pages
""",
)
def x36_findings(spark, sf_dir):
    """Scripts of pages are looked at as JavaScript; loops are told by lines, which markup hasn't."""
    found = F.filter(P.code_findings("html", F.lit("javascript")), lambda x: x != "nested_loops")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("findings"))


@query(
    "x32_resumes",
    rf"""
WITH d AS (SELECT doc_id, lower(text) AS t, nullif(regexp_extract(text, '{P.EMAIL}'), '') AS email FROM documents)
SELECT doc_id, email, array_to_string({_names_sql()}, ',') AS skills FROM d
""",
)
def x32_resumes(spark, sf_dir):
    told = P.resume("text", NAMES, ["Berlin"], F.lit(dt.date(2024, 2, 1)))
    return table(spark, sf_dir, "documents").select("doc_id", told.alias("r")).select("doc_id", "r.contact.email", F.array_join("r.skills", ",").alias("skills"))


@query(
    "x31_entries",
    """
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'bolt|ring') THEN 'x' ELSE '' END AS kind, len(list_filter(regexp_split_to_array(trim(p_name), '[|/,;\\s]+'), lambda x: x <> '')) AS n_parts
FROM part
""",
)
def x31_entries(spark, sf_dir):
    both = P.company_and_title("p_name", ["bolt", "ring"], ["steel"])
    return table(spark, sf_dir, "part").select("p_partkey", F.when(both["title"] != "", "x").otherwise("").alias("kind"), F.size(P.entry_parts("p_name")).cast("long").alias("n_parts"))


@query(
    "s6_reports",
    """
SELECT event_type, CASE WHEN json_valid(props) THEN 'read' ELSE 'invalid' END AS status, count(*) AS n
FROM events GROUP BY ALL UNION ALL SELECT 'page', CASE WHEN json_valid(html) THEN 'read' ELSE 'invalid' END, count(*)
FROM pages GROUP BY ALL
""",
)
def s6_reports(spark, sf_dir):
    """What can't be read as JSON becomes a row of the report instead of an error."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("props").alias("raw")).unionByName(table(spark, sf_dir, "pages").select(F.lit("page").alias("event_type"), F.col("html").alias("raw")))
    status = F.when(F.try_parse_json("raw").isNotNull(), "read").otherwise("invalid")
    return rows.groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))
