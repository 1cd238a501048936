"""Queries of rubrics. Orders stand for posts, their customers for candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import scoring as S
from lodestrata.plans.registry import query
from lodestrata.runtime import table

#: Skills by number, and the family of some.
SKILLS = ["sql", "spark", "java", "scala", "python", "go"]
FAMILIES = {"java": "jvm", "scala": "jvm", "sql": "data", "spark": "data"}


def _subset(number):
    """The skills whose bits are set in a number."""
    return F.array_compact(F.array(*(F.when(number.bitwiseAND(F.lit(1 << i)) > 0, F.lit(s)) for i, s in enumerate(SKILLS))))


def _subset_sql(number: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN ({number}) & {1 << i} > 0 THEN '{s}' END" for i, s in enumerate(SKILLS)) + "], lambda x: x IS NOT NULL)"


def _coverage_sql(owned: str, wanted: str, related: float) -> str:
    near = f"(s IN ('java', 'scala') AND list_has_any({owned}, ['java', 'scala']) OR s IN ('sql', 'spark') AND list_has_any({owned}, ['sql', 'spark']))"
    return f"CASE WHEN len({wanted}) = 0 THEN 1.0::DOUBLE ELSE list_sum(list_transform({wanted}, lambda s: CASE WHEN list_contains({owned}, s) THEN 1.0::DOUBLE WHEN {near} THEN {related}::DOUBLE ELSE 0.0::DOUBLE END)) / len({wanted}) END"


_FACTS = f"""
f AS (
  SELECT o_orderkey, {_subset_sql('c_custkey')} AS owned, {_subset_sql('o_orderkey')} AS wanted, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 12)::DOUBLE END AS years,
         (o_orderkey % 8)::DOUBLE AS low, (o_orderkey % 8 + 3)::DOUBLE AS high, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 5 END AS level, o_orderkey % 4 AS needed,
         o_orderkey % 6 AS quantified, c_mktsegment AS home, o_orderpriority AS prio, o_totalprice AS pay, c_acctbal AS expects, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN customer ON c_custkey = o_custkey
), s AS (
  SELECT *, {_coverage_sql('owned', 'wanted', 0.6)} AS covered,
         CASE WHEN years IS NULL THEN 70.0 WHEN years < low THEN greatest(0.0, 100.0 - (low - years) * 25.0) WHEN years > high THEN greatest(60.0, 100.0 - (years - high) * 5.0) ELSE 100.0 END::DOUBLE AS e,
         CASE WHEN needed = 0 THEN 100.0 WHEN level IS NULL THEN 60.0 ELSE least(100.0, greatest(0.0, 100.0 + (level - needed) * 50.0)) END::DOUBLE AS d,
         CASE WHEN len(owned) = 0 THEN 40.0::DOUBLE WHEN len(wanted) = 0 THEN 70.0::DOUBLE ELSE 100.0 * (0.75 * ({_coverage_sql('owned', 'wanted', 0.5)}) + 0.25 * least(quantified, 4) / 4.0) END AS p,
         (CASE WHEN home = 'BUILDING' THEN 60.0 ELSE 0.0 END + CASE WHEN pay * 1.2 >= expects * 20 AND pay <= 1000000000 THEN 40.0 WHEN pay * 1.2 >= expects * 20 * 0.8 THEN 20.0 ELSE 0.0 END)::DOUBLE AS o,
         date_diff('day', day, DATE '1998-08-02') BETWEEN 0 AND 30 AS fresh FROM f
), t AS (
  SELECT *, 0.35 * 100 * covered + 0.20 * e + 0.10 * d + 0.15 * p + 0.10 * 70.0 + 0.10 * o AS raw FROM s
)"""


def _matched(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cust, order = F.col("c_custkey"), F.col("o_orderkey")
    facts = both.select(
        "o_orderkey", _subset(cust).alias("owned"), _subset(order).alias("wanted"), F.when(cust % 11 != 0, (cust % 12).cast("double")).alias("years"),
        (order % 8).cast("double").alias("low"), (order % 8 + 3).cast("double").alias("high"), F.when(cust % 13 != 0, cust % 5).alias("level"), (order % 4).alias("needed"),
        (order % 6).alias("quantified"), "c_mktsegment", F.col("o_totalprice").alias("pay"), (F.col("c_acctbal") * 20).alias("expects"), F.to_date("o_orderdate").alias("day"),
    )
    c = F.col
    none = F.array().cast("array<string>")
    scores = {
        "skills": 100 * c("covered"), "experience": S.experience_score(c("years"), c("low"), c("high")), "education": S.education_score(c("level"), c("needed")),
        "projects": S.project_score(c("owned"), c("wanted"), c("quantified"), FAMILIES), "soft": S.soft_score(none, none),
        "other": S.other_score(c("c_mktsegment"), F.array(F.lit("BUILDING")), c("expects"), F.lit(None).cast("double"), c("pay"), c("pay") * 1.2),
    }
    fresh = F.datediff(F.lit("1998-08-02").cast("date"), c("day")).between(0, 30)
    rated = facts.withColumn("covered", S.coverage(c("owned"), c("wanted"), FAMILIES)).withColumn("total", F.round(S.match_total(scores, fresh), 6))
    meets = F.coalesce(c("years") >= c("low"), F.lit(True)) & F.coalesce((c("needed") == 0) | (c("level") >= c("needed")), F.lit(True))
    return rated.withColumn("advice", S.advice(c("total"), c("covered"), meets))


_TOTAL = "round(CASE WHEN fresh THEN least(100.0, raw * 1.1) ELSE raw END, 6)"


@query(
    "v13_match",
    f"WITH {_FACTS} SELECT o_orderkey, {_TOTAL} AS total, round(covered, 6) AS covered, CASE WHEN {_TOTAL} >= 80 AND covered >= 0.9 AND coalesce(years >= low, true) AND coalesce(needed = 0 OR level >= needed, true) THEN '{S.SAFE}' WHEN {_TOTAL} >= 65 THEN '{S.FIT}' ELSE '{S.REACH}' END AS advice FROM t",
)
def v13_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("o_orderkey", "total", F.round("covered", 6).alias("covered"), "advice")


@query("k8_best_matches", f"WITH {_FACTS} SELECT o_orderkey, {_TOTAL} AS total FROM t ORDER BY total DESC, o_orderkey LIMIT 10")
def k8_best_matches(spark, sf_dir):
    return _matched(spark, sf_dir).select("o_orderkey", "total").orderBy(F.col("total").desc(), "o_orderkey").limit(10)


@query(
    "v16_gaps",
    f"WITH {_FACTS} SELECT o_orderkey, array_to_string(list_filter(wanted, lambda s: NOT list_contains(owned, s) AND NOT (s IN ('java', 'scala') AND list_has_any(owned, ['java', 'scala'])) AND NOT (s IN ('sql', 'spark') AND list_has_any(owned, ['sql', 'spark']))), ',') AS missing FROM t",
)
def v16_gaps(spark, sf_dir):
    return _matched(spark, sf_dir).select("o_orderkey", F.array_join(S.missing(F.col("owned"), F.col("wanted"), FAMILIES), ",").alias("missing"))


_ANSWER = "len(list_filter(['the', 'of', 'and', 'ion'], lambda w: contains(lower(text), w)))"


@query(
    "v17_answers",
    f"""
SELECT conv_id, turn, round(40.0 * {_ANSWER} / 4 + 7.5 * (contains(text, 'the')::INT + contains(text, 'ing')::INT) + least(20.0, 7.0 * len(regexp_extract_all(text, '[0-9]+')))
  + CASE WHEN length(trim(text)) < 30 THEN 2.0 WHEN length(trim(text)) < 60 THEN 5.0 WHEN length(trim(text)) <= 1000 THEN 6.0 ELSE 4.0 END + CASE WHEN contains(text, ',') THEN 4.0 ELSE 0.0 END, 6) AS score
FROM conversations WHERE role = 'assistant'
""",
)
def v17_answers(spark, sf_dir):
    hits = F.size(F.filter(F.array(*map(F.lit, ["the", "of", "and", "ion"])), lambda w: F.lower("text").contains(w)))
    structure = F.col("text").contains("the").cast("int") + F.col("text").contains("ing").cast("int")
    score = S.answer_score(hits, F.lit(4), structure, F.regexp_count("text", F.lit("[0-9]+")), F.col("text"), F.col("text").contains(","))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.round(score.cast("double"), 6).alias("score"))


@query(
    "v12_completeness_score",
    r"""
SELECT doc_id, (CASE WHEN regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]+') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(text, '\+?\d[\d -]{8,}\d') THEN 7 ELSE 0 END + least(n_chars // 100, 10) * 2
  + CASE WHEN n > 1 THEN 8 ELSE 0 END + least(q, 4) * 3 + 5 + least(n, 5) * 4 + CASE WHEN length(trim(text)) BETWEEN 300 AND 5000 THEN 5 ELSE 0 END + CASE WHEN n >= 3 THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), 'xxx|lorem|todo') THEN 0 ELSE 5 END)::DOUBLE AS score
FROM (SELECT *, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '[0-9]+')) AS q FROM documents)
""",
)
def v12_completeness_score(spark, sf_dir):
    text, lines = F.col("text"), F.size(F.split("text", "\n"))
    found = lambda p: F.regexp_extract("text", p, 0)
    score = S.resume_score(
        found(r"[\w.+-]+@[\w-]+\.[\w.]+"), found(r"\+?\d[\d -]{8,}\d"), F.floor(F.col("n_chars") / 100), F.when(lines > 1, lines).otherwise(0), lines,
        F.regexp_count("text", F.lit("[0-9]+")), F.lit("school"), F.lit(""), F.least(lines, F.lit(5)), text,
    )
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("double").alias("score"))
