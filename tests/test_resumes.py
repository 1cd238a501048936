from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import resumes as R

TEXT = """张三
zhang@example.com 138-0013-8000

## 一、自我评价：
- 热爱技术
【专业技能】: Python、SQL
工作经历
没有日期的一行
还有一行
2021.07-2023.06 北京某某科技有限公司 | 后端开发工程师
• 负责 2022.01-2022.03 的项目上线，支持了很多很多很多很多用户的使用
- 2023.06-至今 主导重构
三、实习经历
2020.07-2020.12 小店
教育背景：
硕士 2018.09-2021.06
北方大学 计算机科学与技术 本科及以上
2014.09-2018.06
项目经历
项目甲 spark
1. 细节
电商项目 2019.01-2019.05
荣誉
""" + "\n".join(f"({i}) 奖项{i}" for i in range(1, 13))


def read(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.asDict(recursive=True) for r in R.parsed(docs, "id", {"python": ["python"], "spark": ["spark"], "sql": ["sql"], "drive": ["主导"]}, ["北京"], F.lit(dt.date(2024, 1, 1)), soft={"drive": ["主导"]}).orderBy("id").collect()]


def test_whole_resume(spark):
    got = read(spark, TEXT)[0]
    assert got["contact"]["email"] == "zhang@example.com" and got["contact"]["phone"] == "13800138000" and got["contact"]["name"] == "张三"
    assert got["summary"] == "热爱技术" and got["skills"] == ["python", "sql", "spark"] and got["soft_skills"] == ["drive"]
    assert got["experience"] == [
        {"company": "没有日期的一行", "title": "", "period": "", "highlights": ["还有一行"]},
        {"company": "北京某某科技有限公司", "title": "后端开发工程师", "period": "2021.07-2023.06", "highlights": ["负责 2022.01-2022.03 的项目上线，支持了很多很多很多很多用户的使用", "2023.06-至今 主导重构"]},
        {"company": "小店", "title": "", "period": "2020.07-2020.12", "highlights": []},
    ]
    assert got["education"] == [
        {"school": "", "degree": "硕士", "major": "", "period": "2018.09-2021.06"},
        {"school": "北方大学", "degree": "本科及以上", "major": "计算机科学与技术", "period": "2014.09-2018.06"},
    ]
    assert got["projects"] == [{"name": "项目甲 spark", "period": "", "highlights": ["细节"]}, {"name": "电商项目", "period": "2019.01-2019.05", "highlights": []}]
    assert got["awards"] == [f"奖项{i}" for i in range(1, 11)] and got["years"] == pytest.approx(3.5)


def test_documents_are_mapped_by_themselves(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT.replace("zhang", "li"))], "id long, text string")
    got = R.parsed(docs, "id", {"sql": ["sql"]}, ["北京"], F.lit(dt.date(2024, 1, 1)))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # no line is shuffled, and no section joined
    assert sorted((r["contact"]["email"], len(r["experience"]), len(r["education"]), len(r["awards"])) for r in got.collect()) == [(f"{x}@example.com", 3, 2, 10) for x in ("li", "zhang")]


@pytest.mark.parametrize("rows,want", [([], [[]]), ([1, 2], [[1, 2]]), ([0, 1, 0, 0, 2], [[], [0, 1], [0], [0, 2]]), ([3, 0], [[3], [0]])])
def test_cut(spark, rows, want):
    assert spark.createDataFrame([(rows,)], "x array<int>").select(R.cut(F.col("x"), lambda x, i: x == 0)).first()[0] == want


def test_texts_without_sections(spark):
    rows = read(spark, None, "", "no heading\nat all")
    assert [(r["summary"], r["experience"], r["education"], r["projects"], r["awards"], r["years"]) for r in rows] == [("", [], [], [], [], None)] * 3


@pytest.mark.parametrize(
    "line,want",
    [("工作经历", ("experience", "")), ("# 二、项目经验（部分）", ("projects", "")), ("技能：a: b", ("skills", "a: b")), ("【荣誉】 ", ("awards", "")), ("技能很多很多很多很多", None), ("a", None), ("", None), ("证书: ", ("certificates", ""))],
)
def test_headings(spark, line, want):
    got = spark.createDataFrame([(line,)], "x string").select(R.header(F.col("x"), R.SECTIONS).alias("h")).first()["h"]
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("line,want", [("本科及以上学历", "本科及以上"), ("大专，本科优先", "本科"), ("学历不限", "学历不限"), ("研究生或硕士", "硕士"), ("none", None), ("高中", "高中")])
def test_degrees(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(R.degree(F.col("x"))).first()[0] == want
