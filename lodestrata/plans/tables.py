"""Queries on the order tables: filters, joins, aggregates, windows and merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.operators import aggregates as A
from lodestrata.operators import dedup as D
from lodestrata.operators import merge as M
from lodestrata.operators import windows as N
from lodestrata.operators.retrieval import packed
from lodestrata.plans.registry import query
from lodestrata.runtime import table

#: "Now" of all queries: the tables end before it.
AS_OF = dt.date(1998, 12, 1)


@query(
    "f1_where",
    """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_returnflag = 'N' AND l_quantity >= 10 AND l_quantity < 30 AND l_linestatus IN ('O', 'F') AND (l_discount IS NULL OR l_discount <> 0.05)
""",
)
def f1_where(spark, sf_dir):
    wanted = {"l_returnflag": "N", "l_quantity": {"$gte": 10, "$lt": 30}, "l_linestatus": {"$in": ["O", "F"]}, "l_discount": {"$ne": 0.05}}
    return table(spark, sf_dir, "lineitem").where(P.where(wanted)).select("l_orderkey", "l_linenumber")


@query("f2_missing_keys", "SELECT event_type, count(*) AS n FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 GROUP BY event_type")
def f2_missing_keys(spark, sf_dir):
    wanted = {"k": {"$gt": 50}, "absent": {"$nin": ["x"], "$ne": 3}}
    found = table(spark, sf_dir, "events").where(P.where(wanted, lambda key: F.get_json_object("props", f"$.{key}")))
    return found.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "f3_overlap",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_retailprice + 100 >= 1000 AND p_retailprice - 100 <= 1500 GROUP BY p_brand",
)
def f3_overlap(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").where(P.ranges_overlap(price - 100, price + 100, 1000, 1500)).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "f6_tolerant",
    """
SELECT c_custkey FROM customer WHERE (c_mktsegment = '' OR contains(c_mktsegment, 'BUILD') OR contains('BUILD', c_mktsegment))
 AND (c_nationkey - 2 <= 12 AND c_nationkey + 2 >= 12)
""",
)
def f6_tolerant(spark, sf_dir):
    fits = P.contains_either(F.col("c_mktsegment"), F.lit("BUILD")) & P.years_fit(12, F.col("c_nationkey"), F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").where(fits).select("c_custkey")


@query(
    "f14_expired",
    """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE TIMESTAMP '1998-12-01' >= o_orderdate + to_days(CAST(30 * (o_custkey % 60) AS INT)) GROUP BY o_orderpriority
""",
)
def f14_expired(spark, sf_dir):
    ttl = (30 * (F.col("o_custkey") % 60)).cast("int")
    gone = P.expired(F.lit(None).cast("timestamp"), F.col("o_orderdate"), ttl, F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf_dir, "orders").where(gone).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "f15_stale",
    """
SELECT c_custkey, coalesce(u.n, 0) AS uses FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) u ON u.o_custkey = c_custkey
WHERE c_acctbal < 9000 AND coalesce(u.n, 0) <= 4
""",
)
def f15_stale(spark, sf_dir):
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    kept = table(spark, sf_dir, "customer").where("c_acctbal < 9000").select("c_custkey").join(used, "c_custkey", "left")
    return kept.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("uses")).where("uses <= 4")


#: Rules in the order in which they are tried: a pattern of the type, a least size, a decision.
RULES = [(1, "PROMO%", 40, "ask"), (2, "%BRASS", 0, "deny"), (3, "%", 25, "allow"), (4, "STANDARD%", 0, "ask")]


@query(
    "f21_first_rule",
    "SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' AND p_size >= 40 THEN 'ask' WHEN p_type LIKE '%BRASS' THEN 'deny' WHEN p_size >= 25 THEN 'allow' "
    "WHEN p_type LIKE 'STANDARD%' THEN 'ask' ELSE 'default' END AS decision FROM part",
)
def f21_first_rule(spark, sf_dir):
    decision = F.lit("default")
    for _, pattern, least, verdict in reversed(RULES):
        decision = F.when(F.col("p_type").like(pattern) & (F.col("p_size") >= least), verdict).otherwise(decision)
    return table(spark, sf_dir, "part").select("p_partkey", decision.alias("decision"))


@query("f25_fresh", "SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') BETWEEN 0 AND 30")
def f25_fresh(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(P.fresh(F.to_date("o_orderdate"), F.lit(dt.date(1998, 6, 1)), 30)).select("o_orderkey")


@query(
    "f26_rollup",
    """
SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN 'pending' WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'success' END AS state
FROM lineitem GROUP BY l_orderkey
""",
)
def f26_rollup(spark, sf_dir):
    state = F.when(F.bool_or(F.col("l_linestatus") == "O"), "pending").when(F.bool_or(F.col("l_returnflag") == "R"), "failed").otherwise("success")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(state.alias("state"))


@query(
    "j2_lookup",
    """
SELECT r_name, n_name, count(c_custkey) AS n, coalesce(sum(c_acctbal), 0) AS balance
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
GROUP BY r_name, n_name
""",
)
def j2_lookup(spark, sf_dir):
    # summed by key first, so that the lookups see a row for each nation
    summed = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"), F.sum("c_acctbal").alias("balance"))
    named = summed.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.sum("balance").alias("balance"))


@query(
    "j3_alias_keys",
    """
WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'id' WHEN lower(replace(c_mktsegment, ' ', '')) IN ('machinery', 'furniture') THEN 'alias' ELSE 'name' END AS how, lower(replace(c_mktsegment, ' ', '')) AS seg
FROM customer)
SELECT how, CASE how WHEN 'alias' THEN 'industry' WHEN 'id' THEN 'id' ELSE seg END AS key, count(*) AS n FROM k GROUP BY ALL
""",
)
def j3_alias_keys(spark, sf_dir):
    flat = F.lower(F.regexp_replace("c_mktsegment", r"\s+", ""))
    aliases = F.create_map(F.lit("machinery"), F.lit("industry"), F.lit("furniture"), F.lit("industry"))
    by_id, by_alias = F.when(F.col("c_custkey") % 3 == 0, F.lit("id")), F.try_element_at(aliases, flat)
    how = F.when(by_id.isNotNull(), "id").when(by_alias.isNotNull(), "alias").otherwise("name")
    return table(spark, sf_dir, "customer").groupBy(how.alias("how"), F.coalesce(by_id, by_alias, flat).alias("key")).agg(F.count("*").alias("n"))


@query(
    "j4_semi",
    "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
)
def j4_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    names = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")), F.when(F.col("l_quantity") > 49, F.col("l_suppkey"))))
    return table(spark, sf_dir, "part").join(lines.select(F.explode(names).alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query(
    "j5_prioritised",
    """
WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey, l_linenumber, coalesce(o.o_custkey, s.s_suppkey, 0) AS partner,
       CASE WHEN o.o_custkey IS NOT NULL THEN 'order' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' ELSE 'none' END AS how
FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey LEFT JOIN s ON s_suppkey = l_suppkey
""",
)
def j5_prioritised(spark, sf_dir):
    """Lines of orders that aren't pending go to the customer, others to the supplier if it isn't in debt."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("found"))
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(orders, "l_orderkey", "left").join(suppliers, "l_suppkey", "left")
    how = F.when(F.col("o_custkey").isNotNull(), "order").when(F.col("found").isNotNull(), "supplier").otherwise("none")
    return both.select("l_orderkey", "l_linenumber", F.coalesce("o_custkey", "found", F.lit(0)).cast("long").alias("partner"), how.alias("how"))


@query("j6_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j6_anti(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return D.unseen(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey")


@query(
    "j8_labels",
    "SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good, count_if(coalesce(toxic, 0) = 1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang",
)
def j8_labels(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("known").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.count_if(F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


#: Words looked for in part types, with the family each belongs to.
WORDS = {"STANDARD": "plain", "SMALL": "size", "MEDIUM": "size", "LARGE": "size", "ECON": "price", "PROMO": "price"}


@query(
    "j9_dictionary",
    "WITH w(word, family) AS (VALUES " + ", ".join(f"('{w}', '{f}')" for w, f in WORDS.items()) + ") "
    "SELECT p_partkey, family, min(instr(p_type, word)) AS first_at, count(*) AS n FROM part JOIN w ON contains(p_type, word) GROUP BY p_partkey, family",
)
def j9_dictionary(spark, sf_dir):
    hits = F.array_compact(F.array(*(F.when(F.instr("p_type", w) > 0, F.struct(F.lit(f).alias("family"), F.instr("p_type", w).alias("at"))) for w, f in WORDS.items())))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(hits).alias("h"))
    return rows.groupBy("p_partkey", F.col("h.family").alias("family")).agg(F.min("h.at").cast("long").alias("first_at"), F.count("*").alias("n"))


@query(
    "j17_snapshot_diff",
    """
WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n OR a.m <> b.m
""",
)
def j17_snapshot_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    at = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m"))
    return M.snapshot_diff(at(orders.where("o_orderkey % 3 < 2")), at(orders.where("o_orderkey % 3 > 0")), "k", "n", "m")


@query(
    "j18_set_ops",
    """
WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag) FILTER (WHERE l_linenumber % 2 = 0))) AS a, list_sort(list_distinct(list(l_returnflag) FILTER (WHERE l_linenumber % 2 = 1))) AS b
FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') AS common, array_to_string(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), ',') AS only_even
FROM s
""",
)
def j18_set_ops(spark, sf_dir):
    flags = lambda r: F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == r, F.col("l_returnflag"))))
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flags(0).alias("a"), flags(1).alias("b"))
    return sets.select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("common"), F.array_join(F.array_except("a", "b"), ",").alias("only_even"))


@query("j14_pairs", "SELECT p_brand || '/' || r AS pair, count(*) AS n FROM part, (VALUES ('EUROPE'), ('ASIA')) v(r) GROUP BY 1")
def j14_pairs(spark, sf_dir):
    # the second side is a literal list, so each row is repeated by an explode
    regions = F.array(F.lit("EUROPE"), F.lit("ASIA"))
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return brands.select(F.explode(regions).alias("r"), "p_brand", "n").select(F.concat_ws("/", "p_brand", "r").alias("pair"), "n")


@query(
    "a1_projection",
    """
SELECT n_regionkey, count(*) AS n, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments, arg_min(c_name, c_custkey) AS first_name,
       max(c_name) AS last_name, CASE WHEN bool_or(c_acctbal > 9900) THEN 'active' ELSE 'stale' END AS status
       FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey
""",
)
def a1_projection(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_regionkey").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.min_by("c_name", "c_custkey").alias("first_name"),
        F.max("c_name").alias("last_name"), F.when(F.bool_or(F.col("c_acctbal") > 9900), "active").otherwise("stale").alias("status"),
    )


@query(
    "a2_quantiles",
    """
SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS least, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS median,
       quantile_cont(l_extendedprice, 0.75) AS p75, max(l_extendedprice) AS most, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag
""",
)
def a2_quantiles(spark, sf_dir):
    out = A.quantile_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumn("mean", F.round("mean", 4))


@query(
    "a4_compare",
    """
WITH g AS (SELECT unnest(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN [o_orderpriority, 'important'] ELSE [o_orderpriority] END) AS grp, o_totalprice AS v
FROM orders),
b AS (SELECT quantile_cont(v, 0.5) AS base FROM g)
SELECT grp, count(v) AS n, quantile_cont(v, 0.5) AS median, round(100 * (quantile_cont(v, 0.5) - any_value(base)) / any_value(base), 6) AS vs_overall_pct
FROM g, b GROUP BY grp
""",
)
def a4_compare(spark, sf_dir):
    groups = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.array("o_orderpriority", F.lit("important"))).otherwise(F.array("o_orderpriority"))
    return A.compared(table(spark, sf_dir, "orders"), groups, "o_totalprice").withColumn("vs_overall_pct", F.round("vs_overall_pct", 6))


@query(
    "a6_status_counts",
    "SELECT v.s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = v.s GROUP BY v.s",
)
def a6_status_counts(spark, sf_dir):
    return A.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "P", "X"])


@query(
    "a7_funnel",
    """
SELECT user_id, count(*) AS n, count_if(date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') <= 7) AS this_week, count_if(event_type IN ('click', 'purchase')) AS n_click,
       100.0 * count_if(event_type IN ('click', 'purchase')) / count(*) AS click_rate, count_if(event_type = 'purchase') AS n_purchase, 100.0 * count_if(event_type = 'purchase') / count(*) AS purchase_rate
FROM events GROUP BY user_id
""",
)
def a7_funnel(spark, sf_dir):
    age = F.datediff(F.lit(dt.date(2024, 1, 30)), F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*A.funnel(F.col("event_type"), age, {"click": ["click", "purchase"], "purchase": ["purchase"]}))


@query(
    "a16_report",
    """
WITH r AS (SELECT l_shipmode_ AS source, act FROM (SELECT l_returnflag AS l_shipmode_, CASE WHEN l_quantity > 40 THEN 'inserted' WHEN l_quantity > 20 THEN 'updated' ELSE 'skipped' END AS act
FROM lineitem))
SELECT coalesce(source, 'all') AS source, count(*) AS fetched, count_if(act = 'inserted') AS inserted, count_if(act = 'updated') AS updated, count_if(act = 'skipped') AS skipped
FROM r GROUP BY ROLLUP (source)
""",
)
def a16_report(spark, sf_dir):
    action = F.when(F.col("l_quantity") > 40, "inserted").when(F.col("l_quantity") > 20, "updated").otherwise("skipped")
    return A.action_report(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), action.alias("action")), "source", "action", ["inserted", "updated", "skipped"])


#: Prices by the beginning of a type; of several the longest counts.
PRICES = {"PROMO": 2.0, "STANDARD": 1.0, "STANDARD POLISHED": 1.5}


@query(
    "a19_costs",
    """
SELECT p_type, CASE WHEN p_type LIKE 'STANDARD POLISHED%' THEN 1.5 WHEN p_type LIKE 'STANDARD%' THEN 1.0 WHEN p_type LIKE 'PROMO%' THEN 2.0 END::DOUBLE * sum(p_size) AS cost, count(*) AS n
FROM part GROUP BY p_type
""",
)
def a19_costs(spark, sf_dir):
    price = F.lit(None).cast("double")
    for prefix in sorted(PRICES, key=len):
        price = F.when(F.startswith("p_type", F.lit(prefix)), PRICES[prefix]).otherwise(price)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.sum("p_size").alias("s"), F.count("*").alias("n")).select("p_type", (price * F.col("s")).alias("cost"), "n")


@query(
    "a26_completeness",
    "SELECT p_partkey, ((p_name <> '')::INT + (p_brand <> '')::INT + (p_type LIKE 'P%')::INT + (p_size IS NOT NULL)::INT) / 4.0 AS share FROM part",
)
def a26_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("promo", F.when(F.startswith("p_type", F.lit("P")), "yes"))
    return rows.select("p_partkey", A.completeness(["p_name", "p_brand", "promo", "p_size"]).alias("share"))


@query(
    "a25_span",
    "SELECT o_custkey, greatest(0, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)))) AS span_days, count(*) AS n FROM orders GROUP BY o_custkey",
)
def a25_span(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.greatest(F.lit(0), F.datediff(F.max(day), F.min(day))).cast("long").alias("span_days"), F.count("*").alias("n"))


@query(
    "a14_dashboard",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_orderstatus, rank, o_orderkey, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = r.o_orderstatus) AS n
FROM r WHERE rank <= CASE o_orderstatus WHEN 'O' THEN 6 ELSE 5 END
""",
)
def a14_dashboard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    best = N.latest(orders, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 6).where((F.col("rank") <= 5) | (F.col("o_orderstatus") == "O"))
    return best.join(orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "o_orderstatus").select("o_orderstatus", F.col("rank").cast("long").alias("rank"), "o_orderkey", "n")


@query(
    "w5_round_robin",
    """
WITH b AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment
ORDER BY c_custkey) AS round, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first_seen
FROM customer)
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY round, first_seen) AS place FROM b
""",
)
def w5_round_robin(spark, sf_dir):
    dealt = N.round_robin(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), [F.col("c_custkey")], ["c_nationkey"])
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy("round", "first_seen")).cast("long")
    return dealt.select("c_nationkey", "c_custkey", place.alias("place"))


@query(
    "w1_packing",
    """
WITH c AS (SELECT l_orderkey, l_linenumber, l_extendedprice, greatest(1, CAST(l_quantity AS BIGINT)) AS cost FROM lineitem),
s AS (SELECT *, sum(cost) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS e FROM c)
SELECT l_orderkey, l_linenumber, CAST(least(cost, 100 - (e - cost)) AS BIGINT) AS used, e > 100 AS truncated
FROM s WHERE e <= 100 OR (e - cost <= 100 AND 100 - (e - cost) >= 10)
""",
)
def w1_packing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    kept = packed(lines, 100, ["l_orderkey"], F.col("l_quantity").cast("long"), [F.col("l_extendedprice").desc(), F.col("l_linenumber")], least=10)
    return kept.select("l_orderkey", "l_linenumber", F.col("used").cast("long").alias("used"), "truncated")


@query(
    "w14_runs",
    """
WITH f AS (SELECT *, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS s
FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment
FROM f)
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(event_id) AS least_event FROM g GROUP BY user_id, segment
""",
)
def w14_runs(spark, sf_dir):
    cut = N.segments(table(spark, sf_dir, "events"), F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"])
    return cut.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"))


@query(
    "w13_sections",
    """
WITH s AS (SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id
ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'preamble') AS section
FROM events)
SELECT section, count(*) AS n FROM s GROUP BY section
""",
)
def w13_sections(spark, sf_dir):
    header = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string"))
    return N.filled_forward(table(spark, sf_dir, "events"), header, ["user_id"], ["ts", "event_id"], "preamble").groupBy("section").agg(F.count("*").alias("n"))


@query(
    "w16_recent_unique",
    """
WITH l AS (SELECT user_id, event_type, max(event_id) AS last_event FROM events GROUP BY ALL)
SELECT user_id, event_type, last_event FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_event DESC) <= 3
""",
)
def w16_recent_unique(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_event"))
    return N.latest(last, ["user_id"], [F.col("last_event").desc()], 3).drop("rank")


@query(
    "t2_sessions",
    """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM h GROUP BY user_id, k
""",
)
def t2_sessions(spark, sf_dir):
    return N.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")


@query(
    "k13_latest",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20",
)
def k13_latest(spark, sf_dir):
    return N.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 20).select("o_custkey", "o_orderkey")


@query(
    "k17_reminders",
    """
SELECT o_orderkey, a AS age_days, CASE WHEN a >= 14 THEN 'stale' WHEN a >= 7 THEN 'follow-up' ELSE 'recent' END AS level
FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS a
FROM orders WHERE o_orderstatus = 'O')
""",
)
def k17_reminders(spark, sf_dir):
    age = F.datediff(F.lit(AS_OF), F.to_date("o_orderdate")).cast("long")
    level = F.when(F.col("age_days") >= 14, "stale").when(F.col("age_days") >= 7, "follow-up").otherwise("recent")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", age.alias("age_days")).withColumn("level", level)


@query("k9_queue", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 10")
def k9_queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_orderpriority")


@query("k10_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def k10_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("d1_last_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def d1_last_wins(spark, sf_dir):
    return D.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("d2_first_wins", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) = 1")
def d2_first_wins(spark, sf_dir):
    first = D.first_wins(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"], [F.col("l_orderkey"), F.col("l_linenumber")])
    return first.select("l_orderkey", "l_linenumber", "l_suppkey")


@query("d3_any_key")
def d3_any_key(spark, sf_dir):
    """A fold by order, which SQL can't express; tests compare it with a loop."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), "l_partkey", "l_suppkey", (F.col("l_quantity") % 3).alias("third"))
    return D.any_key(lines, ["l_partkey", "l_suppkey", "third"], "seq", ["l_orderkey"])


@query(
    "d6_facts",
    """
WITH r AS (SELECT event_type || ':' || user_id AS k, value, event_id, row_number() OVER (PARTITION BY event_type, user_id
ORDER BY value DESC, event_id DESC) AS rn, min(event_id) OVER (PARTITION BY event_type, user_id) AS position
FROM events)
SELECT k, event_id, position FROM r WHERE rn = 1
""",
)
def d6_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "user_id").alias("k"), "value", "event_id")
    return D.merged_facts(rows, "k", "value", "event_id").select("k", "event_id", "position")


@query(
    "d8_label_union",
    "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type) FILTER (WHERE event_id % 2 = 0), ['seen']))), ',') AS labels FROM events GROUP BY user_id",
)
def d8_label_union(spark, sf_dir):
    own = F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(own, F.array(F.lit("seen")))), ",").alias("labels"))


@query(
    "u1_upsert",
    """
SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT l_partkey, CAST(arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS INT) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey
""",
)
def u1_upsert(spark, sf_dir):
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("p_size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return M.upsert(table(spark, sf_dir, "part").select("p_partkey", "p_size"), changed, "p_partkey", "seq")


_MERGE_SQL = """
WITH a AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS h FROM customer WHERE c_custkey % 4 < 3),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE upper(c_name) END AS name, c_mktsegment AS seg, c_nationkey + (c_custkey % 5 = 0)::INT AS h
FROM customer WHERE c_custkey % 4 > 0),
m AS (SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(b.name, ''), a.name) AS name, coalesce(b.h, a.h) AS h,
  CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'keep' WHEN a.h = b.h THEN 'skip' ELSE 'update' END AS action FROM a FULL JOIN b ON a.k = b.k)
"""


def _merged(spark, sf_dir):
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = rows.where(k % 4 < 3).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("h"))
    new = rows.where(k % 4 > 0).select(k.alias("k"), F.when(k % 7 == 0, "").otherwise(F.upper("c_name")).alias("name"), (F.col("c_nationkey") + (k % 5 == 0).cast("int")).alias("h"))
    return M.merge(old, new, "k", "h")


@query("u4_merge", _MERGE_SQL + "SELECT k, name, h, action FROM m")
def u4_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@query("u4_merge_report", _MERGE_SQL + "SELECT action, count(*) AS n FROM m GROUP BY action")
def u4_merge_report(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("u5_stale", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' AND o_orderstatus <> 'P' THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def u5_stale(spark, sf_dir):
    old = F.col("o_orderdate") < F.lit(dt.date(1995, 1, 1)).cast("timestamp")
    return M.marked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), old, "o_orderstatus", "S", "P").drop("o_orderdate")


@query("u2_delete", "SELECT s_suppkey FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def u2_delete(spark, sf_dir):
    return M.delete(table(spark, sf_dir, "supplier"), condition=F.col("s_acctbal") < 0).select("s_suppkey")


@query(
    "u11_transitions",
    "WITH s AS (SELECT event_id, CAST(user_id % 9 AS INT) AS a, CAST(event_id % 9 AS INT) AS b FROM events) SELECT event_id, CASE WHEN a >= 7 THEN false WHEN b = 8 THEN true ELSE b > a END AS allowed FROM s",
)
def u11_transitions(spark, sf_dir):
    states = F.array(*map(F.lit, [*M.STATES, M.REJECTED]))
    now, then = (F.element_at(states, (F.col(c) % 9 + 1).cast("int")) for c in ("user_id", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", M.transition_allowed(now, then).alias("allowed"))


@query(
    "u14_usage",
    "SELECT c_custkey, coalesce(n, 0) AS use_count, last_used FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_used FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def u14_usage(spark, sf_dir):
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_used"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("use_count"), "last_used")
