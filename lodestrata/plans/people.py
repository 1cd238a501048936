"""Queries over résumés, which are written from customers and their orders and read again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import resumes as R
from lodestrata.operators import review as V
from lodestrata.operators import scoring
from lodestrata.plans.registry import query
from lodestrata.runtime import scratch, settle, spread, table

_NAMES = {"python": ["python"], "sql": ["sql"], "spark": ["spark", "pyspark"]}


def _resumes(spark, sf_dir):
    """A job for each order, a school, a project for each third order and awards."""
    orders = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), "o_custkey")
    when = lambda more: F.concat(F.year("o_orderdate") + 8 + more, F.date_format("o_orderdate", ".MM"))
    dated = orders.withColumn("period", F.concat(when(0), F.lit(" - "), when(1)))
    job = F.concat_ws("\n", F.concat(F.lit("A"), "o_orderkey", F.lit("科技公司 | 工程师 "), "period"), F.concat(F.lit("- 负责 "), "o_orderpriority"), F.concat(F.lit("* 2 "), "o_orderstatus"))
    project = F.concat_ws("\n", F.concat(F.lit("项目 P"), "o_orderkey", F.lit(" "), "period"), F.concat(F.lit("• spark "), "o_orderstatus"))
    all_of = lambda c, keep=F.lit(True): F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("o_orderkey", c.alias("t"))))), lambda r: r["t"]), "\n")
    work = dated.groupBy("o_custkey").agg(all_of(job).alias("jobs"), all_of(project, F.col("o_orderkey") % 3 == 0).alias("projects"))
    people = table(spark, sf_dir, "customer").join(work.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left")  # texts are made by all tasks, not by the few that read customers
    degree = F.element_at(F.array(F.lit("本科"), F.lit("硕士及以上"), F.lit("大专")), F.col("c_custkey").cast("int") % 3 + 1)
    text = F.concat_ws(
        "\n", F.col("c_name"), F.concat(F.lit("mail c"), "c_custkey", F.lit("@example.com")), F.lit("【自我评价】"), F.lit("- works well"), F.concat(F.lit("二、专业技能："), F.lit("SQL")),
        F.lit("## 工作经历"), F.col("jobs"), F.lit("教育背景"), F.lit("北方大学 2001.09-2005.06"), F.concat(F.lit("计算机专业，"), degree), F.lit("项目经验"), F.col("projects"), F.lit("荣誉奖项"), F.concat(F.lit("1. first "), "c_nationkey"),
    )
    return people.select("c_custkey", text.alias("text"))


_JOBS_SQL = """
o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, printf('%d.%02d-%d.%02d', year(o_orderdate) + 8, month(o_orderdate), year(o_orderdate) + 9, month(o_orderdate)) AS period, year(o_orderdate) + 8 + (month(o_orderdate) - 1) / 12.0 AS low FROM orders),
j AS (SELECT o_custkey, string_agg('A' || o_orderkey || '科技公司/工程师/' || period || '/负责 ' || o_orderpriority || ';2 ' || o_orderstatus, '|' ORDER BY o_orderkey) AS jobs,
  string_agg('项目 P' || o_orderkey || '/' || period || '/spark ' || o_orderstatus, '|' ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS projects, count(*) AS n, round(max(low) + 1 - min(low), 1) AS years FROM o GROUP BY o_custkey)"""


@query(
    "x32_sections",
    f"""
WITH {_JOBS_SQL}
SELECT c_custkey, 'c' || c_custkey || '@example.com' AS email, 'works well' AS summary, CASE WHEN projects IS NULL THEN 'sql' ELSE 'sql,spark' END AS skills, coalesce(jobs, '') AS jobs,
  '北方大学/' || CASE c_custkey % 3 WHEN 0 THEN '本科' WHEN 1 THEN '硕士及以上' ELSE '大专' END || '/计算机/2001.09-2005.06' AS schools, coalesce(projects, '') AS projects, 'first ' || c_nationkey AS awards, CAST(coalesce(years, 3.8) AS DOUBLE) AS years
FROM customer LEFT JOIN j ON o_custkey = c_custkey
""",
)
def x32_sections(spark, sf_dir):
    """All of a parsed résumé, its entries flattened."""
    got = R.parsed(_resumes(spark, sf_dir), "c_custkey", _NAMES, ["Berlin"], F.lit(dt.date(2024, 2, 1)))
    flat = lambda c, *fields: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *(F.array_join(e[f], ";") if f == "highlights" else e[f] for f in fields))), "|").alias(c if c != "experience" else "jobs")
    return got.select(
        "c_custkey", F.col("contact.email").alias("email"), "summary", F.array_join("skills", ",").alias("skills"), flat("experience", "company", "title", "period", "highlights"),
        flat("education", "school", "degree", "major", "period").alias("schools"), flat("projects", "name", "period", "highlights"), F.array_join("awards", "|").alias("awards"), "years",
    )


@query(
    "s39_store",
    f"""
WITH {_JOBS_SQL}
SELECT c_custkey, coalesce(n, 0) AS n_jobs, CAST(8 + CASE WHEN projects IS NULL THEN 2 ELSE 4 END + CASE WHEN n > 0 THEN 8 ELSE 0 END + 10 + 4 * (2 + CASE WHEN n > 0 THEN 1 ELSE 0 END) + CASE WHEN 2 * n >= 3 THEN 5 ELSE 0 END + 5 AS DOUBLE) AS score
FROM customer LEFT JOIN j ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0
""",
)
def s39_store(spark, sf_dir):
    """Résumés are parsed and stored with a score, some of them again; a seventh is deleted."""
    texts = settle(_resumes(spark, sf_dir), "resumes")
    read = settle(R.parsed(texts, "c_custkey", _NAMES, ["Berlin"], F.lit(dt.date(2024, 2, 1))), "parsed")
    listed = F.aggregate("experience", F.lit(0), lambda n, e: n + F.size(e["highlights"]))
    school = F.get("education", F.lit(0))
    sections = sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in ("skills", "education")), F.when(F.size("experience") > 0, 1).otherwise(0))
    score = scoring.resume_score(F.col("contact.email"), F.col("contact.phone"), F.size("skills"), F.size("experience"), listed, F.lit(0), school["school"], school["degree"], sections, F.lit(""))
    store = R.ResumeStore(spark, scratch(spark, "resume-store"))
    store.append(read.where("c_custkey % 2 = 0"), "c_custkey", F.lit(-1.0))
    store.append(read, "c_custkey", score)
    store.delete(texts.where("c_custkey % 7 = 0"), "c_custkey")
    return store.all().select("c_custkey", F.size("experience").cast("long").alias("n_jobs"), "score")

#: Code with planted faults, by the remainder of a key, with what a review says of it.
_CODE: list[tuple[str, str, str]] = [
    ("def f{0}(n):\n    for i in range(n):\n        for j in range(n):\n            print(i, j)\n", "python n^2", "3:nested_loops"),
    ("items{0} = [1, 2]\nfor x in range(9):\n    if x in items{0}:\n        print(x)\n    print(sorted(items{0}))\n", "python n * n log n", "3:list_search_in_loop,5:sort_in_loop"),
    ("def g{0}(rows, seen=[]):\n    out = ''\n    while rows:\n        out += rows.pop()\n    return out\n", "python n", "0:shared_default,4:string_grown_in_loop"),
    ("def fib{0}(n):\n    return fib{0}(n - 1) + fib{0}(n - 2)\n", "python 1 to n", "0:plain_recursion"),
    ("#include <vector>\nusing namespace std;\nint main() {{\n  for (int i = 0; i < v{0}.size(); i++) {{\n    while (f(i)) {{ std::cout << i << std::endl; }}\n  }}\n}}\n", "cpp n^2", "0:flushed_output,0:size_in_condition,5:nested_loops"),
    ("public class A{0} {{\n  private int n;\n  boolean f(String s) {{ return s == \"x\"; }}\n}}\n", "java 1 to n", "0:string_identity"),
    ("const a{0} = 1;\nconst f = () => a{0} == 2;\n", "javascript 1 to n", "0:loose_equality"),
    ("def find{0}(xs, x):\n    import bisect\n    low, high = 0, len(xs)\n    while low < high:\n        mid = (low + high) // 2\n        low = mid + 1\n    while True:\n        pass\n", "python log n", "0:endless_loop"),
]


@query(
    "x36_review",
    "SELECT p_partkey, split_part(told, ' ', 1) AS language, substr(told, instr(told, ' ') + 1) AS complexity, found AS findings FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{told}', '{found}')" for i, (_, told, found) in enumerate(_CODE))
    + f") v(i, told, found) ON p_partkey % {len(_CODE)} = i",
)
def x36_review(spark, sf_dir):
    """Pieces of code named by parts are reviewed."""
    forms = F.array(*(F.lit(body.replace("{{", "{").replace("}}", "}")) for body, _, _ in _CODE))
    code = F.replace(F.element_at(forms, (F.col("p_partkey") % len(_CODE) + 1).cast("int")), F.lit("{0}"), F.col("p_partkey").cast("string"))
    got = V.reviews(spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", code.alias("code")))
    return got.select("p_partkey", "language", "complexity", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["line"].cast("string"), f["name"])), ",").alias("findings"))
