"""Record functions on real strings, branch by branch."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.functions import text as X
from lodestrata.sources.ingest import json_lines, objects_with

NAMES = {"C++": ["c++"], "Go": ["golang", "go"], "Java": ["java"], "JavaScript": ["javascript", "js"], "机器学习": ["机器学习", "ml"]}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("Java and C++, then Go", ["Java", "C++", "Go"]), ("javascript only", ["JavaScript"]), ("cgo, go-lang, ergo", ["Go"]), ("熟悉机器学习和Java", ["机器学习", "Java"]),
    ("c++11", []), ("JS/ML", ["JavaScript", "机器学习"]), ("", []), (None, []),
])
def test_found_names(spark, text, want):
    assert one(spark, P.found_names(F.lit(text).cast("string"), NAMES)) == want


def test_found_words_and_canonical_names(spark):
    assert one(spark, P.found_words(F.lit("沟通能力强, English fluent"), ["english", "沟通", "none"])) == ["沟通", "english"]
    assert one(spark, P.found_words(F.lit("上海 北京"), ["北京", "上海"], fold=False)) == ["上海", "北京"]
    assert [one(spark, P.canonical(F.lit(t), NAMES)) for t in (" GOLANG ", "java", "Rust ", "c++")] == ["Go", "Java", "Rust", "C++"]


@pytest.mark.parametrize("markup, want", [
    ("plain  text\twith\nlines", "plain text with\nlines"), ("<p>a</p><script>x<b>y</b></script>b", "a b"), ("a<style>p{}</style >b<br/>c", "a b c"),
    ("<object>x<object>y</object>z</object>w", "w"), ("shown<form>never closed", "shown"), ("a &amp; b &lt;c&gt;", "a & b <c>"), ("a<!-- <p> -->b", "a b"),
    ("x < y", "x < y"), ("bell\x07", "bell"), (None, ""), ("<embed/>kept", "kept"), ("<scripted>kept", "kept"),
])
def test_external_text(spark, markup, want):
    assert one(spark, P.external_text(F.lit(markup).cast("string"), 100)) == want


def test_external_text_is_bounded(spark):
    assert one(spark, P.external_text(F.lit("<b>" + "x" * 500 + "</b>"), 7)) == "x" * 7


def test_stable_json_agrees_with_json(spark):
    fields = {"z": "1", "a": 'quo"te', "é": "line\nfeed", "k": None}
    column = F.create_map(*(F.lit(x).cast("string") for kv in fields.items() for x in kv))
    assert one(spark, P.stable_json(column)) == json.dumps(fields, ensure_ascii=False, sort_keys=True)
    turned = F.create_map(*(F.lit(x).cast("string") for kv in reversed(fields.items()) for x in kv))
    assert one(spark, P.metadata_digest(column)) == one(spark, P.metadata_digest(turned)) != ""
    assert one(spark, P.metadata_digest(F.create_map().cast("map<string,string>"))) == ""
    assert set(one(spark, P.scalar_metadata(column))) == {"z", "a", "é"}


def test_company_keys(spark):
    assert one(spark, P.company_key(F.lit(" ＡＢＣ　Co. Ltd "))) == "abcco.ltd"
    assert one(spark, P.company_id(F.lit("abcco.ltd"))) == "company:abcco-ltd"
    han = one(spark, P.company_id(F.lit("杭州星辰")))
    assert han.startswith("company:") and len(han) == len("company:") + 20


@pytest.mark.parametrize("text, want", [
    ("2021.07 - 2023.06 at A", ["2021.07-2023.06"]), ("2019年3月 - 至今", ["2019年3月-至今"]), ("2018—2020，2020/1～2021", ["2018-2020"]), ("2019到2021 and 2022 - Present", ["2019-2021", "2022-Present"]), ("1999-2001", []), (None, []),
])
def test_periods(spark, text, want):
    assert one(spark, P.periods(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("period, want", [
    ("2021.07-2023.06", (2021.5, 2023 + 5 / 12)), ("2020-present", (2020.0, 2024 + 1 / 12)), ("2020-13", None), ("2020.13-2021", (2020.0, 2021.0)), ("2020", None), ("x-2020", None),
])
def test_period_bounds(spark, period, want):
    got = one(spark, P.period_bounds(F.lit(period), F.lit(dt.date(2024, 2, 9))))
    assert tuple(got) == (pytest.approx(want) if want else (None, None))


def test_contact(spark):
    text = "张三丰\n电话: 138-1234-5678 邮箱 a.b@example.com\n现居：杭州\nhttps://example.com/me。\n"
    assert tuple(one(spark, P.contact(F.lit(text), ["北京", "杭州"]))) == ("a.b@example.com", "13812345678", "https://example.com/me", "张三丰", "杭州")
    assert tuple(one(spark, P.contact(F.lit("个人简历\n姓名：李四\n在北京工作"), ["北京"]))) == (None, None, None, "李四", "北京")
    assert tuple(one(spark, P.contact(F.lit(None).cast("string"), ["北京"]))) == (None,) * 5


def test_posting(spark):
    text = "职位名称：后端工程师\n公司: 星辰科技\n地点 上海\n要求 Java 和 Go\n有 C++ 经验优先"
    got = one(spark, P.posting(F.lit(text), NAMES, ["北京", "上海"]))
    assert tuple(got) == ("后端工程师", "星辰科技", "上海", ["Java", "Go"], ["C++"])
    hinted = one(spark, P.posting(F.lit("Java"), NAMES, ["北京"], title=" T ", company="C", city="深圳"))
    assert tuple(hinted) == ("T", "C", "深圳", ["Java"], [])
    assert tuple(one(spark, P.posting(F.lit(None).cast("string"), NAMES, ["北京"]))) == ("", "", "", [], [])


@pytest.mark.parametrize("code, want", [
    ("import os\ndef f(x):\n    return x", "python"), ("public class A { private int x; }", "java"), ("const a = () => 1;", "javascript"), ("#include <x>\nstd::vector<int> v;", "cpp"), ("package main\nfunc f() { x := 1 }", "go"), ("words", ""), (None, ""),
])
def test_code_language(spark, code, want):
    assert one(spark, P.code_language(F.lit(code).cast("string"))) == want


@pytest.mark.parametrize("code, want", [
    ("for a in x:\n    while b:\n        c()\n    for d in y:\n        e()", 2), ("for a in x:\n    f()\nfor b in y:\n    g()", 1), ("x = 1", 0),
    ("for a in x:\n\n    # for nothing\n    for b in a:\n        for c in b: pass", 3), ("", 0), (None, 0), ("formed = 1", 0),
])
def test_loop_depth(spark, code, want):
    assert one(spark, P.loop_depth(F.lit(code).cast("string"))) == want


@pytest.mark.parametrize("code, language, want", [
    ("def f(x=[]):\n    for i in range(len(x)):\n        pass", "python", ["range_of_length", "shared_default"]), ("while True:\n    f()", "", ["endless_loop"]), ("while True:\n    break", "python", []),
    ('if (a == "x") {}', "java", ["string_identity"]), ("a == b", "javascript", ["loose_equality"]), ("a === b !== c", "javascript", []), ("a == b", "java", []), ("std::cout << std::endl;\nfor (int i = 0; i < v.size(); i++) {}", "cpp", ["flushed_output", "size_in_condition"]),
    ("for a in b:\n    for c in d:\n        pass", "python", ["nested_loops"]), ("def f(n):\n    return f(n - 1)", "python", ["plain_recursion"]), ("@cache\ndef f(n):\n    return f(n - 1)", "python", []), (None, "", []),
])
def test_code_findings(spark, code, language, want):
    assert one(spark, P.code_findings(F.lit(code).cast("string"), F.lit(language))) == want


def test_entries_of_resumes(spark):
    line = "2021.07-2023.06 星辰科技有限公司 | 后端工程师 / 杭州"
    assert one(spark, P.entry_parts(F.lit(line))) == ["星辰科技有限公司", "后端工程师", "杭州"]
    assert tuple(one(spark, P.company_and_title(F.lit(line), ["工程师"], ["有限公司"]))) == ("星辰科技有限公司", "后端工程师")
    assert tuple(one(spark, P.company_and_title(F.lit("后端工程师 某处"), ["工程师"], ["有限公司"]))) == ("某处", "后端工程师")
    assert tuple(one(spark, P.company_and_title(F.lit(""), ["工程师"], ["有限公司"]))) == ("", "")


def test_resume(spark):
    text = "姓名：李四 a@b.cn\n2019.01-2020.06 甲\n2021.07-至今 乙 Java, C++"
    got = one(spark, P.resume(F.lit(text), NAMES, ["北京"], F.lit(dt.date(2024, 1, 5))))
    assert got["contact"]["name"] == "李四" and got["skills"] == ["Java", "C++"] and got["periods"] == ["2019.01-2020.06", "2021.07-至今"] and got["years"] == 5.0
    assert one(spark, P.resume(F.lit("none"), NAMES, ["北京"], F.lit(dt.date(2024, 1, 5))))["years"] is None


@pytest.mark.parametrize("text, lines, size, want", [
    ("a\nb\nc\n", 2, 100, ("a\nb", True)), ("a\nb\n", 5, 100, ("a\nb", False)), ("ab\ncdef", 5, 5, ("ab", True)), ("ééé", 5, 3, ("é", True)), ("ab\ncd\nef", 5, 6, ("ab\ncd", True)), ("", 5, 5, ("", False)), (None, 5, 5, ("", False)),
])
def test_bounded_text(spark, text, lines, size, want):
    assert tuple(one(spark, P.bounded_text(F.lit(text).cast("string"), lines, size))) == want


@pytest.mark.parametrize("value, want", [
    ('["u1", " u2 ", ""]', ["u1", "u2"]), ('[{"id": "a"}, {"userId": "b"}, {"_id": " c "}, {"x": 1}, {"id": "", "userId": "d"}]', ["a", "b", "c", "d"]), ("{}", []), ("no", []), (None, []),
])
def test_mention_ids(spark, value, want):
    assert one(spark, P.mention_ids(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("text, want", [
    ('["a.md", " b.md ", ""]', ["a.md", "b.md"]), ('{"paths": ["x"]}', ["x"]), ('{"other": 1}', []), ("- a.md\n\n  - b.md\nc.md", ["a.md", "b.md", "c.md"]), ("", []),
])
def test_selected_paths(spark, text, want):
    assert one(spark, P.selected_paths(F.lit(text))) == want


def test_json_object(spark):
    assert [one(spark, P.json_object(F.lit(t))) for t in (' {"a": 1} ', 'so: {"a": {"b": 1}} end', "none")] == ['{"a": 1}', '{"a": {"b": 1}}', "none"]


@pytest.mark.parametrize("url, want", [
    ("https://example.com/a?b", None), ("http://8.8.8.8", None), ("ftp://example.com", "scheme"), ("https:///path", "host"), ("https://u:p@example.com", "credentials"), ("http://127.0.0.1:80/", "address"), ("http://10.1.2.3", "address"),
    ("http://172.20.0.1", "address"), ("http://172.40.0.1", None), ("http://[::1]/", "address"), ("http://[2001:4860::8888]/", None), ("http://localhost:3000", "local"), ("http://db.internal", "local"), ("http://server", "label"), ("", "scheme"), (None, "scheme"),
    ("https://EXAMPLE.com.:443/", None), ("http://169.254.169.254/x", "address"), ("http://[2001:db8::1]/", "address"),
])
def test_url_problem(spark, url, want):
    assert one(spark, P.url_problem(F.lit(url).cast("string"))) == want


def test_formatted_figures(spark):
    assert one(spark, P.thousands(F.lit(25000), F.lit(40500), F.lit(14))) == "25-40K·14薪"
    assert one(spark, P.thousands(F.lit(25000), F.lit(41500), F.lit(12))) == "25-42K"
    assert one(spark, P.score_bar(F.lit(50.0), 10)) == "[#####-----]  50.0" and one(spark, P.score_bar(F.lit(None), 4)) == "[----]   0.0"
    assert one(spark, P.record_text([("Title", F.lit("a")), ("City", F.lit(None))], F.lit("body\n"))) == "Title: a\nCity: \n\nbody"


def test_route_fit_and_visible_sections(spark):
    fit = one(spark, P.route_fit(F.lit("Data"), F.lit("Lead"), F.lit("sql data"), {"data": ["data", "sql"], "lead": ["lead"]}))
    assert [tuple(x) for x in fit] == [("data", 50 + 10 + 3 + 3, 3), ("lead", 58, 1)]
    seen = one(spark, P.visible_sections(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("x")), ["a", "b", "c"]))
    assert tuple(seen) == (["b"], ["a", "c"])


def test_json_lines():
    value = {"a": None, "b": {"c": True, "d": {}, "e": "two\nlines"}, "f": [1, {"g": 2}, []], "h": []}
    assert "\n".join(json_lines(value)).split("\n") == ["a: None", "b:", "  c: True", "  d:", "  e: two", "  lines", "f:", "  1", "  ", "  g: 2", "h:"]
    assert json_lines([]) == [] and json_lines("x") == ["x"]


def test_objects_at_any_depth(spark):
    deep = {"id": 0}
    for i in range(1, 200):
        deep = {"id": i, "below": [deep]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "no json"), (3, None)], "k int, raw string")
    got = objects_with(["ID"])(df, "raw").collect()
    assert [json.loads(r["object"])["id"] for r in got] == list(range(199, -1, -1))


@pytest.mark.parametrize("text, want", [("博士优先", 4), ("硕士及以上", 3), ("研究生", 3), ("本科学历", 2), ("大专", 1), ("不限", 0), (None, 0)])
def test_degrees(spark, text, want):
    assert one(spark, X.degree_level(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [
    ("25-40K·14薪", (25000, 40000, 14)), ("1.5-2万/月", (15000, 20000, 12)), ("30-60万/年", (25000, 50000, 12)), ("8000-12000元", (8000, 12000, 12)), ("20K以上", (20000, 20000, 12)), ("面议", (None, None, None)), (None, (None, None, None)),
])
def test_salaries(spark, text, want):
    assert tuple(one(spark, X.salary(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize("args, want", [
    (("c", "s", "chat"), "c:chat"), (("c", "s", "chat", "t"), "c:chat:t:s"), (("c", "s", "chat", "", "given"), "given"), (("c", "s", "chat", None, None, True), "c:chat:s"),
])
def test_session_keys(spark, args, want):
    assert one(spark, X.session_key(*(F.lit(a) for a in args))) == want


@pytest.mark.parametrize(
    "markup,want",
    [
        ("<p>head</p>" + "<form>" * 50 + "x" + "</form>" * 50 + "<p>tail</p>", "head tail"),
        ("a<form>b<object>c</object>d</form>e", "a e"),
        ("a<form>b<object>c</form>d</object>e", "a e"),
        ("a<script>if (1 < 2) { '<form>' }</script>b", "a b"),
        ("a<SCRIPT SRC=x />b<style>c", "a b"),
        ("a</form>b<iframe>c", "a b"),
        ("a<b title='>'>c</b><!-- <form> -->d", "a c d"),
        ("1 < 2 and 3 > 2 <embed>gone", "1 < 2 and 3 > 2"),
        ("<form" * 3000 + ">x", "x"),
        ("<a title='" + "b>" * 5000 + "'>x", "x"),
    ],
)
def test_external_text_counts_depth(spark, markup, want):
    got = spark.createDataFrame([(markup,)], "m string").select(P.external_text("m", 1000)).first()[0]
    assert got == want


def test_a_tie_of_means_is_rounded_up_whatever_the_order_of_sums(spark, tmp_path):
    from lodestrata.plans.records import a21_grades

    values = [42.2, 95.48, 14.82, 53.3, 14.08, 88.82]  # 51.45 on average; their sum in doubles is a little less
    spark.createDataFrame([(1, v) for v in values], "user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert a21_grades(spark, str(tmp_path)).first()["mean"] == 51.5


def test_years_of_periods_are_rounded_as_sql_does(spark, tmp_path):
    import duckdb

    from lodestrata.plans.catalog import QUERIES, SQL

    ends = [(y, m) for y in (2000, 2001, 2005) for m in range(1, 13)]
    rows = [(i, dt.datetime(*e, 3)) for i, pair in enumerate((a, b) for a in ends for b in ends if a <= b) for e in pair]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.sql("SET timezone = 'UTC'")
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    got = QUERIES["x27_periods"](spark, str(tmp_path)).select("o_custkey", "period", "years").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(SQL["x27_periods"]).fetchall())


@pytest.mark.parametrize("text, want", [
    ("项目 P1380000 2010.07 - 2011.07", None), ("P1380000 2010/07", None), ("tel 138 0000 2010.", "13800002010"), ("138-0000-2010, 2010.07", "13800002010"), ("1380000 2010", "13800002010"),
])
def test_a_date_is_no_part_of_a_phone_number(spark, text, want):
    assert one(spark, P.contact(F.lit(text), ["Berlin"])["phone"]) == want


def uses(spark, column, pattern):
    """How often a pattern stands in a plan, which is how often a row is searched for it at most."""
    df = spark.range(1).select(F.col("id").cast("string").alias("text")).select(column.alias("c"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_resume_searches_a_text_once_for_a_name(spark):
    assert uses(spark, P.resume("text", {"a": ["qqa"]}, ["Berlin"], F.lit(dt.date(2024, 2, 1)))["skills"], "(?<![a-z0-9+#])qqa") == 1


def test_posting_searches_a_text_once_for_a_name(spark):
    told = P.posting("text", {"a": ["qqa"]}, ["Berlin"], ["license"])
    assert uses(spark, F.struct(told["required"], told["preferred"]), "(?<![a-z0-9+#])qqa") <= 4  # in all lines and in marked ones


def test_external_text_takes_its_input_few_times(spark):
    assert uses(spark, P.external_text(P.first_given("text", ["qqa"]), 200), "$.qqa") <= 4
