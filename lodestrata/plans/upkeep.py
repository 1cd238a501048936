"""Further queries on records, conversations and schedules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.schedule import scheduled
from lodestrata.operators import retrieval as R
from lodestrata.operators import windows as N
from lodestrata.plans.registry import query
from lodestrata.runtime import table


@query("f24_mentions", "SELECT conv_id, turn, role <> 'user' OR contains(lower(text), 'the') AS mentioned FROM conversations")
def f24_mentions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("role") != "user") | F.lower("text").contains("the")).alias("mentioned"))


@query("a8_trend", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def a8_trend(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    "a9_overview",
    """
SELECT user_id, array_to_string(list(event_type ORDER BY ts DESC, event_id DESC)[1:5], ',') AS recent, count_if(event_type <> 'purchase') AS active
FROM events GROUP BY user_id
""",
)
def a9_overview(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    best = N.latest(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5)
    recent = best.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"]), ",").alias("recent"))
    return recent.join(events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "purchase").alias("active")), "user_id")


@query("j13_names", "SELECT a.event_id, b.event_id AS source FROM events a JOIN events b ON b.event_id = a.event_id - 7 AND b.user_id = a.user_id")
def j13_names(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    calls = events.select(F.col("event_id").alias("source"), "user_id", (F.col("event_id") + 7).alias("event_id"))
    return events.select("event_id", "user_id").join(calls, ["event_id", "user_id"]).select("event_id", "source")


@query(
    "k7_local_top",
    "WITH h AS (SELECT p_partkey, p_size, contains(p_name, 'ring')::INT + contains(p_name, 'red')::INT + contains(p_name, 'small')::INT AS hits FROM part) SELECT p_partkey, hits FROM h WHERE hits > 0 ORDER BY hits DESC, p_size DESC, p_partkey LIMIT 30",
)
def k7_local_top(spark, sf_dir):
    hits = sum((F.col("p_name").contains(t).cast("int") for t in ("red", "small")), F.col("p_name").contains("ring").cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", hits.alias("hits")).where("hits > 0")
    return rows.orderBy(F.col("hits").desc(), F.col("p_size").desc(), "p_partkey").limit(30).select("p_partkey", "hits")


@query("k12_selected", "SELECT c_custkey FROM customer ORDER BY CASE c_custkey WHEN 9 THEN 0 WHEN 3 THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey LIMIT 12")
def k12_selected(spark, sf_dir):
    place = F.array_position(F.array(F.lit(9), F.lit(3)), F.col("c_custkey").cast("int"))
    order = F.when(place > 0, place).otherwise(3)
    return table(spark, sf_dir, "customer").orderBy(order, F.col("c_acctbal").desc(), "c_custkey").limit(12).select("c_custkey")


@query(
    "w2_joint_budget",
    """
WITH c AS (SELECT conv_id, turn, greatest(1, (length(text) + 3) // 4) AS cost
FROM conversations), s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id
ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM c)
SELECT conv_id, turn, CAST(least(cost, 60 - (e - cost)) AS BIGINT) AS used FROM s WHERE e <= 60 OR (e - cost <= 60 AND 60 - (e - cost) >= 1)
""",
)
def w2_joint_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    kept = R.packed(rows, 60, ["conv_id"], X.char_estimate("text"), [F.col("turn")], least=1)
    return kept.select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query(
    "w8_filler",
    """
WITH r AS (SELECT p_brand, p_partkey, p_type, p_type = 'PROMO' AS wanted, row_number() OVER (PARTITION BY p_brand, p_type
ORDER BY p_partkey) AS round FROM part)
SELECT p_brand, p_partkey FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY wanted DESC, round, p_type) <= 6
""",
)
def w8_filler(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("wanted", F.col("p_type") == "PROMO")
    dealt = N.round_robin(part, F.col("p_type"), [F.col("p_partkey")], ["p_brand"])
    return N.latest(dealt, ["p_brand"], [F.col("wanted").desc(), F.col("round"), F.col("p_type")], 6).select("p_brand", "p_partkey")


@query(
    "x10_cut",
    """
SELECT doc_id, CASE WHEN t > 100 THEN substr(text, 1, CAST(floor(length(text) * 100.0::DOUBLE / t) AS BIGINT)) ELSE text END AS text
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t
FROM documents)
""",
)
def x10_cut(spark, sf_dir):
    """Cut in proportion to a token budget."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", X.token_estimate("text").alias("t"))
    cut = F.substr("text", F.lit(1), F.floor(F.length("text") * 100.0 / F.col("t")).cast("int"))
    return rows.select("doc_id", F.when(F.col("t") > 100, cut).otherwise(F.col("text")).alias("text"))


@query(
    "x18_first",
    """
SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END), ''), 'none') AS first, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'x' END AS INT) AS number
FROM events
""",
)
def x18_first(spark, sf_dir):
    first = F.coalesce(F.nullif(F.trim(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))), F.lit("")), F.lit("none"))
    number = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise("x").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", first.alias("first"), number.alias("number"))


@query(
    "x28_bullets",
    r"SELECT doc_id, count_if(regexp_matches(line, '^\s*[-*•|]')) AS bullets, count_if(length(trim(line)) <= 14 AND trim(line) <> '') AS headers FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
)
def x28_bullets(spark, sf_dir):
    lines = F.split("text", "\n")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•|]"))).cast("long")
    headers = F.size(F.filter(lines, lambda x: (F.length(F.trim(x)) <= 14) & (F.trim(x) != ""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", bullets.alias("bullets"), headers.alias("headers"))


@query(
    "x30_quantified",
    r"SELECT doc_id, count_if(regexp_matches(line, '\d')) AS lines, CAST(sum(len(regexp_extract_all(line, '\d+(?:\.\d+)?%?'))) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
)
def x30_quantified(spark, sf_dir):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\d"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"), F.regexp_count("text", F.lit(r"\d+(?:\.\d+)?%?")).cast("long").alias("tokens"))


@query(
    "x42_age_labels",
    """
SELECT o_orderkey, CASE WHEN a = 0 THEN 'today' WHEN a = 1 THEN 'yesterday' ELSE a || ' days ago' END AS label
FROM (SELECT o_orderkey, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02')) AS a
FROM orders)
""",
)
def x42_age_labels(spark, sf_dir):
    age = F.greatest(F.lit(0), F.datediff(F.lit(dt.date(1998, 8, 2)), F.to_date("o_orderdate")))
    label = F.when(age == 0, "today").when(age == 1, "yesterday").otherwise(F.concat(age, F.lit(" days ago")))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query("x45_next_runs", "SELECT event_id, date_trunc('hour', ts) + INTERVAL 30 MINUTES + CASE WHEN minute(ts) >= 30 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOURS END AS next_run FROM events")
def x45_next_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.lit("30 * * * *").alias("e"))
    return scheduled(rows, "e", "ts").select("event_id", "next_run")


@query("x58_manifest", "SELECT lang, string_agg('- [' || source || '] ' || n, chr(10) ORDER BY source) AS manifest FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def x58_manifest(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(F.lit("- ["), x["source"], F.lit("] "), x["n"]))
    return counts.groupBy("lang").agg(F.array_join(lines, "\n").alias("manifest"))


@query("u7_deep_merge", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer")
def u7_deep_merge(spark, sf_dir):
    """Of nested records only the fields given anew change."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("facts")).alias("r"))
    changed = F.when(F.col("c_custkey") % 3 == 0, F.col("r").withField("facts.segment", F.lit("new"))).otherwise(F.col("r"))
    return rows.select("c_custkey", changed.alias("r")).select("c_custkey", "r.name", "r.facts.segment", "r.facts.balance")


@query(
    "u13_slugs",
    """
SELECT p_partkey, lower(replace(p_name, ' ', '-')) || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS slug
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n
FROM part)
""",
)
def u13_slugs(spark, sf_dir):
    """Names of files; of equal ones the second gets a number, and so on."""
    n = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("s"), n.alias("n"))
    return rows.select("p_partkey", F.concat("s", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n"))).otherwise("")).alias("slug"))


@query("c8_documents", "SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS doc FROM conversations GROUP BY conv_id")
def c8_documents(spark, sf_dir):
    part = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(part, "\n").alias("doc"))


@query("c11_writes", "SELECT conv_id, bool_or(role = 'assistant' AND contains(text, 'the')) AS wrote FROM conversations GROUP BY conv_id")
def c11_writes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & F.col("text").contains("the")).alias("wrote"))


@query("v10_budgets", "SELECT conv_id, greatest(0, least(CAST(count(*) * 100 * 0.25 AS BIGINT), 300)) AS budget FROM conversations GROUP BY conv_id")
def v10_budgets(spark, sf_dir):
    budget = F.greatest(F.lit(0), F.least((F.count("*") * 100 * 0.25).cast("long"), F.lit(300)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(budget.cast("long").alias("budget"))


@query(
    "s17_isolated",
    """
SELECT kind, count(*) AS n, count_if(problem IS NOT NULL) AS failed FROM (SELECT 'props' AS kind, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL THEN 'no number' END AS problem
FROM events UNION ALL SELECT 'type', CASE WHEN TRY_CAST(event_type AS INT) IS NULL THEN 'no number' END
FROM events) GROUP BY kind
""",
)
def s17_isolated(spark, sf_dir):
    """A source that fails leaves a note instead of ending the job."""
    events = table(spark, sf_dir, "events")
    one = lambda kind, value: events.select(F.lit(kind).alias("kind"), F.when(value.try_cast("int").isNull(), "no number").alias("problem"))
    both = one("props", F.get_json_object("props", "$.k")).unionByName(one("type", F.col("event_type")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("problem").alias("failed"))


@query("s24_rendered", r"SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || text AS file FROM documents")
def s24_rendered(spark, sf_dir):
    from lodestrata.sources.frontmatter import rendered

    head = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", rendered(["lang", "title"], head, F.col("text")).alias("file"))


@query(
    "s31_mailbox",
    """
SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events a
WHERE a.event_id = e.event_id AND a.event_type IN ('view', 'click')) QUALIFY row_number() OVER (PARTITION BY user_id
ORDER BY ts, event_id) <= 3
""",
)
def s31_mailbox(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    unread = events.join(events.where("event_type IN ('view', 'click')").select("event_id"), "event_id", "left_anti")
    return N.latest(unread, ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id")
