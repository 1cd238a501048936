"""Sections of résumés and the entries in them, cut out of the lines of each text, and a store of parsed résumés."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.functions.text import strip, trimmed
from lodestrata.sources.versions import Versions

# Headings of sections, words of titles, marks of companies, verbs that begin a line of an entry, degrees by level.
SECTIONS: dict[str, list[str]] = {
    "personal": ["个人信息", "基本信息", "联系方式", "个人资料"],
    "summary": ["自我评价", "自我介绍", "个人总结", "个人简介", "自我描述", "个人优势"],
    "education": ["教育经历", "教育背景", "学习经历", "教育信息", "学历背景"],
    "experience": ["工作经历", "工作经验", "职业经历", "实习经历", "工作履历", "实践经历"],
    "projects": ["项目经历", "项目经验", "项目介绍", "主要项目", "项目实践"],
    "skills": ["专业技能", "技能特长", "掌握技能", "技能清单", "技术栈", "技能", "IT技能"],
    "awards": ["荣誉奖项", "获奖经历", "奖项荣誉", "荣誉奖励", "荣誉"],
    "certificates": ["证书", "资格证书", "持证情况", "认证"],
}
TITLES = ["开发工程师", "工程师", "开发", "架构师", "技术专家", "专家", "经理", "主管", "总监", "分析师", "专员", "设计师", "负责人", "测试", "运维", "算法", "产品", "运营", "研究员", "实习生", "实习", "开发实习", "CTO", "CEO"]
COMPANIES = ["公司", "集团", "科技", "网络", "信息", "软件", "技术", "银行", "证券", "保险", "研究院", "研究所", "实验室", "有限", "传媒", "文化", "教育", "医疗", "智能", "数据", "电子商务", "工作室"]
VERBS = ["主导", "负责", "参与", "完成", "搭建", "优化", "设计", "实现", "推动", "维护", "开发", "建设", "重构", "提升", "落地", "协助", "配合"]
DEGREES: list[tuple[str, int]] = [("不限", 0), ("无要求", 0), ("高中", 0), ("中专", 0), ("大专", 1), ("专科", 1), ("本科", 2), ("学士", 2), ("硕士", 3), ("研究生", 3), ("博士", 4)]
PROJECT = "项目"
BULLET = r"^\s*(?:[-*•·▪◦]+\s*|[（(]?\d{1,2}[）).、]\s*(?!\d)|[✓√✅]\s*)"
SCHOOL = r"[一-鿿]{2,16}(?:大学|学院|学校)"
MAJORS = [
    r"专业\s*[:：]?\s*([一-鿿A-Za-z ]{2,18})",
    r"([一-鿿]{2,12})专业",
    r"([一-鿿]{2,14})\s*(?:专业)?\s*(?:本科|硕士|学士|大专|专科|研究生|博士)",
]


def _any(line: Column, words: Sequence[str]) -> Column:
    return P.has_match(line, "|".join(words))


def degree(text: Column) -> Column:
    """The highest degree that a line names, of equal ones the first in ``DEGREES``; null without one."""
    out = F.lit(None).cast("string")
    for level in range(5):
        for word, own in reversed(DEGREES):
            if own == level:
                out = F.when(text.contains(word), F.concat(F.lit(word), F.when(text.contains(word + "及以上"), "及以上").otherwise(""))).otherwise(out)
    return F.when(text.contains("学历不限") | text.contains("不限学历"), "学历不限").otherwise(out)


def major(line: Column) -> Column:
    """The subject of a line on education, empty if there is none: labelled, before its label, or before a degree."""
    labelled, before, near = (F.regexp_extract(line, p, 1) for p in MAJORS)
    return F.when(labelled != "", strip(labelled)).when(before != "", strip(before)).when((near != "") & ~_any(near, ["大学", "学院", "学校"]), near).otherwise("")


def header(line: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """struct<section, rest> of a line that is a heading, else null.

    A heading is a keyword of a section, perhaps with marks or a number around it and up to
    six characters more; what follows its colon is the section's first line.
    """
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(line), r"^[#*【\[]+\s*|\s*[#*】\]]+$", "")), r"^[一二三四五六七八九十\d]{1,3}\s*[、.．)）]\s*", ""))
    section: dict[str, str] = {}
    for name, words in keywords.items():
        for w in words:
            section.setdefault(w, name)
    every = "|".join(map(re.escape, section))
    form = rf"(?s)^(?:(?:{every})(?=\z)|(?:{every})(?=.{{0,6}}\z))"  # all of the head if it is a keyword, else the first keyword that begins it
    sections = F.create_map(*(F.lit(x) for pair in section.items() for x in pair))

    def parts(bare: Column) -> Column:
        colon = F.when(bare.contains("："), "：").when(bare.contains(":"), ":")
        return F.struct(bare.alias("bare"), F.when(colon.isNotNull(), F.split_part(bare, colon, F.lit(1))).alias("raw"))

    def told(x: Column) -> Column:
        head = F.when(x["raw"].isNull(), x["bare"]).otherwise(strip(x["raw"]))
        rest = F.when(x["raw"].isNull(), "").otherwise(strip(F.substr(x["bare"], F.length(x["raw"]) + 2)))
        word = P.once(head, lambda h: F.when(F.length(h) <= 14, F.regexp_extract(h, form, 0)))
        return P.once(word, lambda w: F.when(F.map_contains_key(sections, w), F.struct(F.element_at(sections, w).alias("section"), rest.alias("rest"))))

    marks, number = r"(?:[#*【\[]+\s*)?", r"(?:[一二三四五六七八九十\d]{1,3}\s*[、.．)）]\s*)?"
    return F.when(P.has_match(line, rf"^\s*{marks}{number}(?:{every})"), P.once(P.once(bare, parts), told))  # most lines are no headings


def cut(rows: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """An array in pieces: what stands before the first row that begins one, perhaps nothing, and then a piece for each such row."""
    at = lambda rows: F.array_compact(F.transform(rows, lambda x, i: F.when(begins(x, i), i + 1)))
    ends = lambda rows: P.once(at(rows), lambda n: F.struct(F.concat(F.array(F.lit(1)), n).alias("low"), F.concat(n, F.array(F.size(rows) + 1)).alias("high")))
    return P.once(rows, lambda rows: P.once(ends(rows), lambda e: F.transform(e["low"], lambda low, i: F.slice(rows, low, F.get(e["high"], i) - low))))


def sections(text: str | Column, names: Sequence[str], keywords: Mapping[str, Sequence[str]] = SECTIONS) -> Column:
    """struct of an array of lines for each name: the lines that stand below headings of that section, in order.

    Lines that are empty are left out, and so is the mark of a list. Lines before the first heading are the ``preamble``.
    """
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: P.has_match(x, r"\S"))

    def told(x: Column, head: Column) -> Column:
        line = trimmed(F.regexp_replace(F.rtrim(F.when(head.isNull(), x).otherwise(head["rest"])), BULLET, ""))
        return F.struct(head["section"].alias("section"), line.alias("line"), F.coalesce(head["rest"] == "", F.lit(False)).alias("bare"))

    rows = F.transform(raw, lambda x: P.once(header(x, keywords), lambda head: told(x, head)))
    own = lambda piece: F.coalesce(F.get(piece, F.lit(0))["section"], F.lit("preamble"))
    lines = lambda piece: F.transform(F.filter(piece, lambda r: ~r["bare"]), lambda r: r["line"])
    below = lambda pieces, name: F.flatten(F.transform(F.filter(pieces, lambda x: own(x) == name), lines))
    return P.once(cut(rows, lambda r, i: r["section"].isNotNull()), lambda pieces: F.struct(*(below(pieces, name).alias(name) for name in names)))


def dated_entries(lines: Column, projects: bool = False, titles: Sequence[str] = TITLES, companies: Sequence[str] = COMPANIES, verbs: Sequence[str] = VERBS) -> Column:
    """The entries of the lines of jobs or of projects.

    A line with a period begins an entry if it has a word of titles, a mark of companies or,
    for projects, that of projects, or is short and doesn't begin with a verb or list mark;
    a short line with the mark of projects begins one too. Lines before the first entry are
    an entry named by their first line.
    """

    def begins(line: Column, _: Column) -> Column:
        listed = P.has_match(line, BULLET)
        marked = line.contains(PROJECT) if projects else F.lit(False)
        rest = strip(F.regexp_replace(line, P.PERIOD, " "))
        short = ~listed & P.once(rest, lambda x: (F.length(x) <= 24) & ~P.has_match(x, "^(?:" + "|".join(verbs) + ")"))
        return F.when(P.has_match(line, P.PERIOD), _any(line, titles) | _any(line, companies) | marked | short).otherwise(marked & (F.length(line) <= 40) & ~listed)

    def read(rows: Column, i: Column) -> Column:
        first = F.get(rows, F.lit(0))
        others = F.filter(F.slice(rows, 2, F.size(rows)), lambda x: x != "")
        entry = lambda company, title, period: F.struct(company.alias("company"), title.alias("title"), period.alias("period"), others.alias("highlights"))
        period = F.coalesce(F.get(P.periods(first), F.lit(0)), F.lit(""))
        if projects:
            made = entry(F.substring(strip(F.regexp_replace(first, P.PERIOD, " ")), 1, 80), F.lit(""), period)
        else:
            made = P.once(P.company_and_title(first, titles, companies), lambda both: entry(both["company"], both["title"], period))
        return F.when(i > 0, made).otherwise(entry(F.substring(first, 1, 60), F.lit(""), F.lit("")))

    return F.filter(F.transform(cut(lines, begins), read), lambda e: (F.size(e["highlights"]) > 0) | (e["company"] != ""))


def education_entries(lines: Column) -> Column:
    """School, degree, major and period of each school in the lines of an education.

    A line with a school begins an entry, as does the first one with a degree and a period
    if no school came before it; other lines fill what the entry still lacks.
    """
    part = lambda x: F.struct(F.regexp_extract(x, SCHOOL, 0).alias("school"), F.coalesce(degree(x), F.lit("")).alias("degree"), major(x).alias("major"), F.coalesce(F.get(P.periods(x), F.lit(0)), F.lit("")).alias("period"))
    first = lambda rows, is_so: F.array_position(F.transform(rows, is_so), F.lit(True))
    firsts = lambda rows: F.struct(rows.alias("rows"), first(rows, lambda r: r["school"] != "").alias("school"), first(rows, lambda r: (r["degree"] != "") & (r["period"] != "")).alias("dated"))
    lone = lambda x: F.when((x["school"] == 0) | (x["dated"] < x["school"]), x["dated"]).otherwise(F.lit(0).cast("long"))
    pieces = P.once(P.once(F.transform(lines, part), firsts), lambda x: P.once(lone(x), lambda at: cut(x["rows"], lambda r, i: (r["school"] != "") | (i + 1 == at))))
    fill = lambda piece, c: F.coalesce(F.get(F.filter(F.transform(piece, lambda r: r[c]), lambda v: v != ""), F.lit(0)), F.lit("")).alias(c)
    return F.transform(F.slice(pieces, 2, F.size(lines) + 1), lambda piece: F.struct(*(fill(piece, c) for c in ("school", "degree", "major", "period"))))


def parsed(docs: DataFrame, key: str, names: P.Names, cities: Sequence[str], as_of: Column, text: str = "text", soft: P.Names | None = None) -> DataFrame:
    """(key, contact, summary, skills, soft_skills, experience, education, projects, awards, years) of résumés.

    ``skills`` are those that the section of skills names, and then others in the text.
    Years are those of the periods of the jobs, or of all periods if the jobs have none.
    A null text has no sections. Rows are mapped by themselves; what is used more than once has its own step.
    """
    cut_up = docs.select(key, F.coalesce(text, F.lit("")).alias("text_")).select(key, "text_", sections("text_", ["summary", "skills", "awards", "experience", "education", "projects"]).alias("s_"))
    joined = lambda name: F.array_join(f"s_.{name}", "\n")
    found = P.once(P.periods(joined("experience")), lambda jobs: F.when(F.size(jobs) > 0, jobs).otherwise(P.periods("text_")))
    project = lambda e: F.struct(e["company"].alias("name"), e["period"].alias("period"), e["highlights"].alias("highlights"))
    read = cut_up.select(
        key,
        P.contact("text_", cities).alias("contact"),
        F.substring(joined("summary"), 1, 600).alias("summary"),
        P.found_names(joined("skills"), names).alias("declared_"),
        P.found_names("text_", names).alias("every_"),
        (P.found_names("text_", soft) if soft else F.array().cast("array<string>")).alias("softer_"),
        dated_entries(F.col("s_.experience")).alias("experience"),
        education_entries(F.col("s_.education")).alias("education"),
        F.transform(dated_entries(F.col("s_.projects"), projects=True), project).alias("projects"),
        F.slice("s_.awards", 1, 10).alias("awards"),
        P.span_years(found, as_of).alias("years"),
    )
    skills = F.array_union("declared_", F.array_except("every_", "softer_"))
    return read.select(key, "contact", "summary", skills.alias("skills"), F.array_except("softer_", skills).alias("soft_skills"), "experience", "education", "projects", "awards", "years")


@dataclass
class ResumeStore:
    """Parsed résumés with their score, by id; each change is a new version."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path)

    def all(self) -> DataFrame | None:
        """Everything stored; None before the first one."""
        held = self.versions.current()
        return self.spark.read.parquet(f"{self.versions.folder(held[0])}/resumes") if held else None

    def append(self, rows: DataFrame, key: str, score: Column) -> None:
        """Adds rows of ``parsed`` with ``score``; what has the same id is replaced."""
        rows = rows.withColumn("score", score)
        held = self.all()
        self._publish(rows if held is None else held.join(rows.select(key), key, "left_anti").unionByName(rows))

    def delete(self, ids: DataFrame, key: str) -> int:
        """Takes résumés out and returns how many there were."""
        held = self.all()
        if held is None:
            return 0
        before = held.count()
        self._publish(held.join(ids.select(key), key, "left_anti"))
        return before - self.all().count()

    def _publish(self, rows: DataFrame) -> None:
        number = self.versions.next()
        rows.write.mode("overwrite").parquet(f"{self.versions.folder(number)}/resumes")
        self.versions.publish(number, {})
        self.versions.drop()
