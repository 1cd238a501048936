"""Rubrics as expressions: how well a candidate fits a post, how complete a text is, what comes first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shares of the six dimensions of a match.
WEIGHTS = {"skills": 0.35, "experience": 0.20, "education": 0.10, "projects": 0.15, "soft": 0.10, "other": 0.10}
# The names of the three kinds of advice.
SAFE, FIT, REACH = "保底", "匹配", "冲刺"


def family_of(skill: Column, families: Mapping[str, str]) -> Column:
    """The family that a skill belongs to, or null."""
    if not families:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in families.items() for x in kv)), skill)


def coverage(owned: Column, wanted: Column, families: Mapping[str, str], related: float = 0.6) -> Column:
    """The share of wanted skills that are owned, one of the same family counting for less; 1 if none is wanted."""
    near = F.array_distinct(F.filter(F.transform(owned, lambda s: family_of(s, families)), lambda f: f.isNotNull()))
    one = lambda s: F.when(F.array_contains(owned, s), 1.0).when(F.coalesce(F.array_contains(near, family_of(s, families)), F.lit(False)), related).otherwise(0.0)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.aggregate(F.transform(wanted, one), F.lit(0.0), lambda a, x: a + x) / F.size(wanted))


def missing(owned: Column, wanted: Column, families: Mapping[str, str]) -> Column:
    """Wanted skills that are neither owned nor near one that is."""
    near = F.transform(owned, lambda s: family_of(s, families))
    return F.filter(wanted, lambda s: ~F.array_contains(owned, s) & ~F.coalesce(F.exists(near, lambda f: f == family_of(s, families)), F.lit(False)))


def experience_score(years: Column, low: Column, high: Column) -> Column:
    """100 within the range; 25 less for each year short, 5 less for each beyond down to 60; 70 if unknown."""
    short, beyond = F.greatest(F.lit(0.0), 100.0 - (low - years) * 25.0), F.greatest(F.lit(60.0), 100.0 - (years - high) * 5.0)
    return F.when(years.isNull() | low.isNull(), 70.0).when(years < low, short).when(years > high, beyond).otherwise(100.0)


def education_score(level: Column, needed: Column) -> Column:
    """100 if enough or nothing is needed, 50 less for each level short, 60 if unknown."""
    return F.when(needed.isNull() | (needed == 0), 100.0).when(level.isNull(), 60.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 + (level - needed) * 50.0)))


def project_score(shown: Column, wanted: Column, quantified: Column, families: Mapping[str, str]) -> Column:
    """Three quarters for the first ten wanted skills shown, one for figures given, up to four."""
    return F.when(F.size(shown) == 0, 40.0).when(F.size(wanted) == 0, 70.0).otherwise(100.0 * (0.75 * coverage(shown, F.slice(wanted, 1, 10), families, 0.5) + 0.25 * F.least(quantified, F.lit(4)) / 4.0))


def soft_score(owned: Column, wanted: Column) -> Column:
    """The share of wanted soft skills owned, 70 if none is wanted."""
    return F.when(F.size(wanted) == 0, 70.0).otherwise(100.0 * F.size(F.array_intersect(wanted, owned)) / F.size(wanted))


def other_score(city: Column, cities: Column, least: Column, most: Column, low: Column, high: Column) -> Column:
    """Up to 60 for the place and 40 for the pay."""
    place = F.when(city.isNull() | city.isin("", "远程"), 60.0).when(F.size(cities) == 0, 30.0).when(F.array_contains(cities, city), 60.0).otherwise(0.0)
    floor, roof = F.coalesce(least, F.lit(0)), F.coalesce(most, F.lit(10**9))
    pay = F.when((least.isNull() & most.isNull()) | low.isNull(), 20.0).when((high >= floor) & (low <= roof), 40.0).when(high >= floor * 0.8, 20.0).otherwise(0.0)
    return place + pay


def match_total(scores: Mapping[str, Column], fresh: Column, boost: float = 0.10, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The weighted mean, raised for fresh posts, 100 at most."""
    whole = sum(weights.values())
    total = F.lit(0.0)
    for name, score in scores.items():
        total = total + score * (weights[name] / whole)
    return F.when(fresh, F.least(F.lit(100.0), total * (1 + boost))).otherwise(total)


def advice(total: Column, covered: Column, meets: Column, fit: float = 65.0, safe: float = 80.0) -> Column:
    """Safe needs a high score, nine tenths of the skills and all hard requirements."""
    return F.when((total >= safe) & (covered >= 0.9) & meets, SAFE).when(total >= fit, FIT).otherwise(REACH)


def resume_score(email: Column, phone: Column, skills: Column, entries: Column, highlights: Column, quantified: Column, school: Column, degree: Column, sections: Column, text: Column) -> Column:
    """0 to 100: contact 15, skills 20, work 20, education 10, sections 20, quality of content 15."""
    length = F.length(F.trim(text))
    has = lambda c, points: F.when(F.coalesce(c != "", F.lit(False)), points).otherwise(0.0)
    contact = has(email, 8.0) + has(phone, 7.0)
    work = F.when(entries > 0, 8.0).otherwise(0.0) + F.least(quantified, F.lit(4)) * 3.0
    education = F.when(school.isNull() & degree.isNull(), 0.0).when((school != "") & (degree != ""), 10.0).otherwise(5.0)
    quality = F.when(length.between(300, 5000), 5.0).otherwise(0.0) + F.when(highlights >= 3, 5.0).otherwise(0.0) + F.when(F.lower(text).rlike(r"xxx|lorem|todo|待填|占位"), 0.0).otherwise(5.0)
    return contact + F.least(skills, F.lit(10)) * 2.0 + work + education + sections * 4.0 + quality


def answer_score(hits: Column, asked: Column, structure: Column, quantified: Column, text: Column, linked: Column) -> Column:
    """0 to 100: coverage 40, structure 30 (7.5 a group), figures 20 (7 each), expression 10."""
    length = F.length(F.trim(text))
    cover = F.when(asked > 0, 40.0 * hits / asked).otherwise(F.least(F.lit(32.0), length / 120.0 * 32.0))
    size = F.when(length < 30, 2.0).when(length < 60, 5.0).when(length <= 1000, 6.0).otherwise(4.0)
    return cover + structure * 7.5 + F.least(F.lit(20.0), quantified * 7.0) + size + F.when(linked, 4.0).otherwise(0.0)


def card_score(base: Column, bug: Column, hinted: Column, draft: Column, clean: Column, approved: Column, urgent: Column, age_days: Column) -> Column:
    """The base of the source with what speaks for and against a card; ten days of freshness."""
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    recent = F.greatest(F.lit(0), 10 - F.floor(F.greatest(age_days, F.lit(0))))
    return base + points(bug, 25) + points(hinted, 15) - points(draft, 30) + points(clean, 20) + points(approved, 20) + points(urgent, 20) + recent


def related(wanted: DataFrame, owned: DataFrame, keys: list[str], value: str, family: Column) -> DataFrame:
    """Adds ``state`` to what is wanted: covered if the same owner has it, partial if it has one of its family, or missing.

    ``family`` is a column made from ``value``. Repeated rows of ``owned`` count once.
    """
    same = owned.select(*keys, value).distinct().withColumn("same_", F.lit(True))
    near = owned.select(*keys, family.alias("family_")).distinct().withColumn("near_", F.lit(True))
    both = wanted.withColumn("family_", family).join(same, [*keys, value], "left").join(near, [*keys, "family_"], "left")
    state = F.when(F.col("same_"), "covered").when(F.col("near_"), "partial").otherwise("missing")
    return both.withColumn("state", state).drop("same_", "near_", "family_")
