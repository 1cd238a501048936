"""Queries on records: searches, projections, reports, rankings and upkeep."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import merge as M
from lodestrata.operators import retrieval as R
from lodestrata.operators import windows as N
from lodestrata.plans.registry import query
from lodestrata.runtime import table


@query(
    "f7_search",
    "SELECT p_partkey FROM part WHERE instr(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') > 0 AND p_type = 'ECONOMY' AND coalesce(p_retailprice, 0) >= 900 AND coalesce(p_size, 0) <= 30",
)
def f7_search(spark, sf_dir):
    haystack = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    fits = (F.instr(haystack, "ring") > 0) & (F.col("p_type") == "ECONOMY") & (F.coalesce("p_retailprice", F.lit(0.0)) >= 900) & (F.coalesce("p_size", F.lit(0)) <= 30)
    return table(spark, sf_dir, "part").where(fits).select("p_partkey")


@query(
    "f8_link_trust",
    r"""
WITH u AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host
FROM pages), reg AS (SELECT DISTINCT host, true AS trusted FROM u WHERE page_id % 3 = 0)
SELECT page_id, CASE WHEN trusted AND starts_with(url, 'https:') THEN url ELSE '' END AS link, CASE WHEN trusted AND starts_with(url, 'https:') THEN 'valid' ELSE 'invalid' END AS status
FROM u LEFT JOIN reg USING (host)
""",
)
def f8_link_trust(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]*)", 1).alias("host"))
    registry = pages.where("page_id % 3 = 0").select("host").distinct().withColumn("trusted", F.lit(True))
    good = F.coalesce(F.col("trusted") & F.startswith("url", F.lit("https:")), F.lit(False))
    return pages.join(registry, "host", "left").select("page_id", F.when(good, F.col("url")).otherwise("").alias("link"), F.when(good, "valid").otherwise("invalid").alias("status"))


@query("f10_aliases", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'auto')")
def f10_aliases(spark, sf_dir):
    names = F.array(F.lower("c_name"), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").where(F.exists(names, lambda a: a.contains("7") & ~a.contains("auto") | a.contains("auto"))).select("c_custkey")


#: Names of states that mean another one.
ALIASES = {"open": "O", "final": "F", "part": "P"}


@query("f12_status_alias", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def f12_status_alias(spark, sf_dir):
    wanted = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), F.lit("final")), F.lit("final"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == wanted) & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_orderstatus")


@query("f16_due", "SELECT event_id FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND ts <= TIMESTAMP '2024-01-05 12:00:00'")
def f16_due(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") != "error") & F.col("value").isNotNull() & (F.col("ts") <= F.lit(dt.datetime(2024, 1, 5, 12)))).select("event_id")


@query("f17_touched", "SELECT user_id, max(ts) AS last FROM events WHERE user_id <> 3 GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-29'")
def f17_touched(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id <> 3").groupBy("user_id").agg(F.max("ts").alias("last")).where(F.col("last") > F.lit(dt.datetime(2024, 1, 29)))


@query("f20_references", r"SELECT doc_id, len(regexp_extract_all(text, '\bthere\b|\bthe\b')) AS n FROM documents WHERE regexp_matches(text, '\bthere\b|\bthe\b')")
def f20_references(spark, sf_dir):
    pattern = r"\bthere\b|\bthe\b"
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("n"))


@query("f22_hooks", "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^.*c[kh].*$|^e.*$') GROUP BY event_type")
def f22_hooks(spark, sf_dir):
    matched = F.col("event_type").rlike(X.glob_pattern("*c[kh]*")) | F.col("event_type").rlike(X.glob_pattern("e*"))
    return table(spark, sf_dir, "events").where(matched).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f23_privacy", "SELECT c_custkey, substr(c_name, 1, 3) || '***' AS c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def f23_privacy(spark, sf_dir):
    masked = F.concat(F.substr("c_name", F.lit(1), F.lit(3)), F.lit("***"))
    return table(spark, sf_dir, "customer").select("c_custkey", masked.alias("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"))


@query(
    "f27_guard",
    r"""
SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'length' WHEN regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]+') THEN 'e-mail' WHEN regexp_matches(text, '\+?\d[\d -]{8,}\d') THEN 'phone' END AS reason
FROM documents
""",
)
def f27_guard(spark, sf_dir):
    reason = F.when(F.length("text") > 5000, "length").when(F.col("text").rlike(r"[\w.+-]+@[\w-]+\.[\w.]+"), "e-mail").when(F.col("text").rlike(r"\+?\d[\d -]{8,}\d"), "phone")
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


@query(
    "j11_best_documents",
    r"""
WITH t AS (SELECT DISTINCT doc_id, unnest(list_distinct(string_split_regex(trim(lower(text)), '\s+'))) AS term FROM documents),
b AS (SELECT DISTINCT item_id, unnest(list_distinct(string_split_regex(trim(lower(text)), '\s+'))) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM b JOIN t USING (term) GROUP BY ALL)
SELECT item_id, doc_id, shared FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) <= 3
""",
)
def j11_best_documents(spark, sf_dir):
    return R.most_shared(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 3)


@query("j16_lookup", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE doc_id = 17")
def j16_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query(
    "j19_backups",
    "SELECT user_id, max(ts) AS latest, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY user_id",
)
def j19_backups(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.max_by("event_id", order).alias("event_id"))


@query(
    "a3_salary_query",
    """
WITH m AS (SELECT o_orderpriority AS grp, (o_totalprice + o_totalprice * 2) / 2 AS mid, o_orderkey
FROM orders WHERE contains(o_orderpriority, 'H') OR contains(o_orderpriority, 'U'))
SELECT grp, count(*) AS n, quantile_cont(mid, 0.5) AS median, quantile_cont(mid * 12, 0.5) AS yearly, arg_max(o_orderkey, mid) AS top FROM m GROUP BY grp
""",
)
def a3_salary_query(spark, sf_dir):
    mid = (F.col("o_totalprice") + F.col("o_totalprice") * 2) / 2
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").contains("H") | F.col("o_orderpriority").contains("U")).select(F.col("o_orderpriority").alias("grp"), mid.alias("mid"), "o_orderkey")
    half = lambda c: F.percentile(c, F.lit(0.5))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), half(F.col("mid")).alias("median"), half(F.col("mid") * 12).alias("yearly"), F.max_by("o_orderkey", "mid").alias("top"))


@query(
    "a5_bands",
    """
WITH q AS (SELECT p_type, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.5) AS mid, quantile_cont(p_retailprice, 0.75) AS hi
FROM part GROUP BY p_type)
SELECT p_partkey, CASE WHEN p_retailprice <= lo THEN 'low' WHEN p_retailprice >= hi THEN 'high' ELSE 'middle' END AS band, greatest(p_retailprice, hi) AS anchor, round(100 * (p_retailprice - mid) / mid, 6) AS vs_median
FROM part JOIN q USING (p_type)
""",
)
def a5_bands(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    quartiles = F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    both = part.join(part.groupBy("p_type").agg(quartiles.alias("q")), "p_type")
    price, (lo, mid, hi) = F.col("p_retailprice"), (F.col("q")[i] for i in range(3))
    return both.select("p_partkey", F.when(price <= lo, "low").when(price >= hi, "high").otherwise("middle").alias("band"), F.greatest(price, hi).alias("anchor"), F.round(100 * (price - mid) / mid, 6).alias("vs_median"))


@query("a13_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a13_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "a17_report_sum",
    """
SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS chunks, count_if(l_quantity > 45) AS failed, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS notes
FROM lineitem GROUP BY l_returnflag
""",
)
def a17_report_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("chunks"), F.count_if(F.col("l_quantity") > 45).alias("failed"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("notes"))


@query("a18_usage", "SELECT conv_id, turn, CAST(sum((length(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations")
def a18_usage(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(X.char_estimate("text")).over(w).alias("used"))


@query(
    "a20_sessions",
    """
SELECT conv_id, count(*) AS turns, count_if(role = 'user') AS asked, substr(arg_min(text, turn), 1, 80) AS summary, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS estimate
FROM conversations GROUP BY conv_id
""",
)
def a20_sessions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.substr(F.min_by("text", "turn"), F.lit(1), F.lit(80)).alias("summary"), F.sum(X.char_estimate("text")).alias("estimate"),
    )


@query(
    "a21_grades",
    "SELECT user_id, round(avg(value), 1) AS mean, count_if(value >= 80) AS good, count_if(value < 60) AS poor, round(100.0 * count(value) / count(*), 6) AS done FROM events GROUP BY user_id",
)
def a21_grades(spark, sf_dir):
    value = F.col("value")
    mean = F.round(F.round(F.avg(value), 9), 1)  # sums in any order agree to nine places, so a tie is one in all of them
    return table(spark, sf_dir, "events").groupBy("user_id").agg(mean.alias("mean"), F.count_if(value >= 80).alias("good"), F.count_if(value < 60).alias("poor"), F.round(100.0 * F.count(value) / F.count("*"), 6).alias("done"))


@query(
    "a24_markdown",
    """
SELECT n_regionkey, '## ' || n_regionkey || chr(10) || string_agg('- ' || n_name || ' (' || c || ')', chr(10)
ORDER BY n_name) AS doc FROM (SELECT n_regionkey, n_name, count(*) AS c
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) GROUP BY n_regionkey
""",
)
def a24_markdown(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count("*").alias("c"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_name", "c"))), lambda x: F.concat(F.lit("- "), x["n_name"], F.lit(" ("), x["c"], F.lit(")")))
    return both.groupBy("n_regionkey").agg(F.concat(F.lit("## "), F.col("n_regionkey"), F.lit("\n"), F.array_join(lines, "\n")).alias("doc"))


@query(
    "w7_categories",
    """
WITH m AS (SELECT *, p_type IN ('PROMO', 'SMALL') AS wanted FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type
ORDER BY p_size, p_partkey) AS round FROM m)
SELECT p_brand, p_partkey FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY wanted DESC, round, p_type) <= 10
""",
)
def w7_categories(spark, sf_dir):
    """Wanted types first, one of each a round, the smaller sizes first; other types fill what is left."""
    part = table(spark, sf_dir, "part").withColumn("wanted", F.col("p_type").isin("PROMO", "SMALL"))
    dealt = part.withColumn("round", F.row_number().over(W.partitionBy("p_brand", "p_type").orderBy("p_size", "p_partkey")))
    return N.latest(dealt, ["p_brand"], [F.col("wanted").desc(), F.col("round"), F.col("p_type")], 10).select("p_brand", "p_partkey")


@query("w9_ranks", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def w9_ranks(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")).cast("long")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", rank.alias("rank"))


@query(
    "k5_blend",
    """
WITH s AS (SELECT p_brand, p_partkey, p_retailprice AS a, p_size / 50.0 AS b
FROM part), m AS (SELECT *, min(a) OVER w AS lo, max(a) OVER w AS hi FROM s WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, p_partkey, round((0.7 * CASE WHEN hi > lo THEN (a - lo) / (hi - lo) WHEN a > 0 THEN 1 ELSE 0 END + 0.3 * greatest(0, least(1, b)))::DOUBLE, 6) AS score
FROM m
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round((0.7 * CASE WHEN hi > lo THEN (a - lo) / (hi - lo) WHEN a > 0 THEN 1 ELSE 0 END + 0.3 * greatest(0, least(1, b)))::DOUBLE, 6) DESC, p_partkey) <= 5
""",
)
def k5_blend(spark, sf_dir):
    from lodestrata.operators.retrieval import min_max

    rows = min_max(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("score"), (F.col("p_size") / 50.0).alias("own")), "score", ["p_brand"])
    blend = F.round(0.7 * F.col("score") + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("own"))), 6)
    return N.latest(rows.withColumn("score", blend), ["p_brand"], [F.col("score").desc(), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "score")


@query("k15_target_first", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'signup', value DESC, event_id) <= 4")
def k15_target_first(spark, sf_dir):
    order = [F.col("event_type") != "signup", F.col("value").desc_nulls_last(), F.col("event_id")]
    return N.latest(table(spark, sf_dir, "events"), ["user_id"], order, 4).select("user_id", "event_id")


#: Topics by the syllables that hint at them, in order.
TOPICS = {"a": ["the", "and"], "b": ["ion", "ent"], "c": ["eau", "aux"], "d": ["ung", "heit"]}


@query(
    "k16_topics",
    "WITH h AS (SELECT doc_id, unnest(["
    + ", ".join(f"{{'topic': '{t}', 'place': {i}, 'hits': " + " + ".join(f"contains(text, '{w}')::INT" for w in ws) + "}" for i, (t, ws) in enumerate(TOPICS.items()))
    + "], recursive := true) FROM documents) SELECT doc_id, topic, hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, place) <= 3",
)
def k16_topics(spark, sf_dir):
    # as many candidates as there are topics, ordered within the row
    def one(i: int, name: str, hints: list[str]):
        hits = sum((F.col("text").contains(h).cast("int") for h in hints[1:]), F.col("text").contains(hints[0]).cast("int"))
        return F.struct((-hits).alias("o"), F.lit(i).alias("place"), F.lit(name).alias("topic"), hits.alias("hits"))

    ranked = F.slice(F.array_sort(F.filter(F.array(*(one(i, t, ws) for i, (t, ws) in enumerate(TOPICS.items()))), lambda x: x["hits"] > 0)), 1, 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(ranked).alias("r")).select("doc_id", "r.topic", "r.hits")


@query("d7_distinct_list", "SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n FROM documents")
def d7_distinct_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("n"))


@query("d11_concat", "SELECT 1 AS place, l_orderkey AS k FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_totalprice > 400000")
def d11_concat(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.lit(1).alias("place"), F.col("l_orderkey").alias("k"))
    return first.unionByName(table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.lit(2).alias("place"), F.col("o_orderkey").alias("k")))


@query(
    "d12_seen_urls",
    """
SELECT sha256(trim(url)) AS url_key, min(page_id) AS page_id, count(*) AS n
FROM pages WHERE sha256(trim(url)) NOT IN (SELECT sha256(trim(url)) FROM pages
WHERE page_id % 10 = 0) GROUP BY 1
""",
)
def d12_seen_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.trim("url"), 256).alias("url_key"))
    return pages.join(pages.where("page_id % 10 = 0").select("url_key"), "url_key", "left_anti").groupBy("url_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "d13_missing",
    f"""
SELECT o_custkey, array_to_string(list_filter({PRIORITIES}, lambda x: NOT list_contains(own, x)), ',') AS missing
FROM (SELECT o_custkey, list(o_orderpriority) AS own FROM orders GROUP BY o_custkey)
""",
)
def d13_missing(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("own"))
    return own.select("o_custkey", F.array_join(F.array_except(F.array(*map(F.lit, PRIORITIES)), "own"), ",").alias("missing"))


@query(
    "u9_cards",
    """
WITH c AS (SELECT event_type || ':' || (user_id % 40) AS fingerprint, event_id, event_type, value FROM events)
SELECT fingerprint, count(*) AS seen, min(event_id) AS first_id, max(event_id) AS last_id, max(CAST(floor(value) AS BIGINT)) AS score, array_to_string(list_sort(list_distinct(list(CASE WHEN value > 50 THEN 'high' ELSE 'low' END))), ',') AS labels
FROM c GROUP BY fingerprint
""",
)
def u9_cards(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id") % 40).alias("fingerprint"), "event_id", "value")
    label = F.when(F.col("value") > 50, "high").otherwise("low")
    return rows.groupBy("fingerprint").agg(F.count("*").alias("seen"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.max(F.floor("value")).alias("score"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


@query("u10_journal", "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'open' END AS status, event_type = 'error' AS journalled FROM events")
def u10_journal(spark, sf_dir):
    changed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(changed, "failed").otherwise("open").alias("status"), changed.alias("journalled"))


@query(
    "u15_backfill",
    "SELECT doc_id, coalesce(nullif(source, 'src0'), 'unknown') AS source, coalesce(l.quality, 1) AS importance, l.doc_id IS NULL AS filled FROM documents LEFT JOIN labels l USING (doc_id)",
)
def u15_backfill(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    return table(spark, sf_dir, "documents").join(known, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("source", F.lit("src0")), F.lit("unknown")).alias("source"), F.coalesce("quality", F.lit(1)).alias("importance"), F.col("known").isNull().alias("filled"))


@query(
    "u6_projection",
    """
WITH o AS (SELECT c_nationkey AS k, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS h
FROM customer WHERE c_custkey % 10 > 0 GROUP BY 1), w AS (SELECT c_nationkey AS k, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS h
FROM customer GROUP BY 1)
SELECT w.k, w.n, o.h IS DISTINCT FROM w.h AS refreshed FROM w LEFT JOIN o USING (k)
""",
)
def u6_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    at = lambda x: x.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("h"))
    changed = M.snapshot_diff(at(rows.where("c_custkey % 10 > 0")), at(rows), "k", "h").select("k", F.lit(True).alias("c"))
    return at(rows).join(changed, "k", "left").select("k", "n", F.col("c").isNotNull().alias("refreshed"))


@query("c7_discovery", "SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) <= 2")
def c7_discovery(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return N.latest(first, ["conv_id"], [F.col("first_turn")], 2).drop("rank")


@query("c6_recent", "SELECT conv_id, turn, substr(text, 1, 300) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8")
def c6_recent(spark, sf_dir):
    return N.latest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn").desc()], 8).select("conv_id", "turn", F.substr("text", F.lit(1), F.lit(300)).alias("text"))


@query(
    "c2_split",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, lag(role) OVER (PARTITION BY conv_id
ORDER BY turn) AS before FROM conversations),
b AS (SELECT conv_id, max(CASE WHEN back >= 4 AND NOT (role = 'assistant' AND before = 'user') THEN turn END) AS boundary FROM r GROUP BY conv_id)
SELECT conv_id, turn, turn >= coalesce(boundary, -1) AS recent FROM r JOIN b USING (conv_id)
""",
)
def c2_split(spark, sf_dir):
    """The last turns stay together; the boundary moves back while it would cut a question from its answer."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))).withColumn("before", F.lag("role").over(w))
    cuts = F.coalesce((F.col("role") == "assistant") & (F.col("before") == "user"), F.lit(False))
    boundary = F.max(F.when((F.col("back") >= 4) & ~cuts, F.col("turn"))).over(W.partitionBy("conv_id"))
    return rows.withColumn("b", boundary).select("conv_id", "turn", (F.col("turn") >= F.coalesce("b", F.lit(-1))).alias("recent"))


@query("c9_offload", "SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 600) ELSE text END AS preview, CASE WHEN length(text) > 3000 THEN sha256(text) END AS artifact FROM documents")
def c9_offload(spark, sf_dir):
    long = F.length("text") > 3000
    return table(spark, sf_dir, "documents").select("doc_id", F.when(long, F.substr("text", F.lit(1), F.lit(600))).otherwise(F.col("text")).alias("preview"), F.when(long, F.sha2("text", 256)).alias("artifact"))


@query("t15_retention", "SELECT event_type, count(*) AS kept FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS OR event_type = 'purchase' GROUP BY event_type")
def t15_retention(spark, sf_dir):
    young = F.col("ts") > F.lit(dt.datetime(2024, 1, 23))
    return table(spark, sf_dir, "events").where(young | (F.col("event_type") == "purchase")).groupBy("event_type").agg(F.count("*").alias("kept"))


@query(
    "t11_gates",
    """
SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE ts > TIMESTAMP '2024-01-20'
GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) >= 5 AND max(ts) - min(ts) >= INTERVAL 24 HOURS
""",
)
def t11_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("ts") > F.lit(dt.datetime(2024, 1, 20)))
    told = rows.groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return told.where((F.col("days") >= 5) & (F.timestamp_diff("HOUR", F.col("a"), F.col("b")) >= 24)).select("user_id", "days")


@query("x26_degrees", "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS level FROM part")
def x26_degrees(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ["不限", "大专或以上", "本科/学士", "硕士 优先 本科", "博士"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.degree_level(words).alias("level"))


@query(
    "x46_ages",
    """
SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS age, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM orders
""",
)
def x46_ages(spark, sf_dir):
    stated = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    day = F.try_to_date(F.substr(stated, F.lit(1), F.lit(10)), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit(dt.date(1998, 12, 1)), F.to_date("o_orderdate")).cast("long").alias("age"), F.date_format(day, "yyyy-MM-dd").alias("day"))


@query(
    "x60_envelopes",
    "SELECT event_id, event_type || ' & <' || user_id || '>' AS summary, CAST(event_id AS VARCHAR) AS task FROM events",
)
def x60_envelopes(spark, sf_dir):
    """Wraps fields in an envelope and takes them out again."""
    escaped = F.replace(F.replace(F.replace(F.concat(F.col("event_type"), F.lit(" & <"), F.col("user_id"), F.lit(">")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("<task-notification><task-id>"), F.col("event_id"), F.lit("</task-id><summary>"), escaped, F.lit("</summary></task-notification>")).alias("x"))
    return rows.select("event_id", X.unescaped(F.regexp_extract("x", "(?s)<summary>(.*?)</summary>", 1)).alias("summary"), F.regexp_extract("x", "<task-id>(.*?)</task-id>", 1).alias("task"))


@query("x49_pieces", "SELECT doc_id, count(*) AS lines, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def x49_pieces(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("lines"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"))


@query(
    "x34_direction",
    """
SELECT doc_id, CASE WHEN fr = 0 AND de = 0 AND es = 0 THEN 'other' WHEN fr >= de AND fr >= es THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS direction
FROM (SELECT doc_id, len(regexp_extract_all(text, 'eau|aux|tion')) AS fr, len(regexp_extract_all(text, 'ung|heit|sch')) AS de, len(regexp_extract_all(text, 'ción|mente|ado')) AS es
FROM documents)
""",
)
def x34_direction(spark, sf_dir):
    hits = [(F.regexp_count("text", F.lit(p)), name) for name, p in (("fr", "eau|aux|tion"), ("de", "ung|heit|sch"), ("es", "ción|mente|ado"))]
    most = F.greatest(*(h for h, _ in hits))
    pick = F.when(most == 0, "other")
    for h, name in hits:  # the first of equals
        pick = pick.when(h == most, name)
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("direction"))


@query("s18_adapter", "SELECT user_id, count(*) AS n, string_agg(event_type, chr(10) || chr(10) ORDER BY ts, event_id) AS body FROM events WHERE event_type <> 'view' GROUP BY user_id")
def s18_adapter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(parts, "\n\n").alias("body"))


@query(
    "s20_cards",
    """
SELECT source, count(*) AS n FROM (SELECT 'page' AS source, page_id AS id
FROM pages UNION ALL SELECT 'turn', conv_id FROM conversations WHERE role = 'user'
UNION ALL SELECT 'event', event_id FROM events WHERE event_type = 'error')
GROUP BY source
""",
)
def s20_cards(spark, sf_dir):
    one = lambda name, rows, key: rows.select(F.lit(name).alias("source"), F.col(key).alias("id"))
    cards = one("page", table(spark, sf_dir, "pages"), "page_id").unionByName(one("turn", table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id")).unionByName(one("event", table(spark, sf_dir, "events").where("event_type = 'error'"), "event_id"))
    return cards.groupBy("source").agg(F.count("*").alias("n"))


@query("s27_tail", "SELECT user_id, event_id FROM events WHERE props IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def s27_tail(spark, sf_dir):
    """The last rows in file order; rows that are no JSON are skipped."""
    good = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull())
    return N.latest(good, ["user_id"], [F.col("event_id").desc()], 5).select("user_id", "event_id")


@query("s36_results", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS links, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS names FROM pages)
SELECT page_id, i AS place, links[i] AS link, names[i] AS name FROM (SELECT *, unnest(range(1, least(len(links), 3) + 1)) AS i FROM a)
""")
def s36_results(spark, sf_dir):
    pattern = F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    found = F.slice(F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("link"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("name")), 1, 3)
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "r"))
    return rows.select("page_id", (F.col("place") + 1).cast("long").alias("place"), F.col("r.link").alias("link"), F.col("r.name").alias("name"))
