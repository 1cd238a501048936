"""Markdown files with a head of named fields between lines of three dashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.predicates import expired

_HEAD = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def head(text: Column) -> Column:
    """The fields of the head as a map; of no head, or one that isn't closed, an empty one."""
    lines = F.filter(F.split(F.regexp_extract(text, _HEAD, 1), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[\w-]+\s*:\s*(.*?)\s*$", 1), r"""^(["'])(.*)\1$""", "$2").alias("value"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    first = F.aggregate(F.transform(lines, entry), none, lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.map_from_entries(first)


def body(text: Column) -> Column:
    """What follows the head."""
    return F.regexp_replace(text, _HEAD, "")


def rendered(fields: list[str], values: Column, text: Column) -> Column:
    """A file of known fields in order, then the others by name, then the text."""
    known = F.array(*map(F.lit, fields))
    names = F.concat(F.filter(known, lambda k: F.map_contains_key(values, k)), F.array_sort(F.array_except(F.map_keys(values), known)))
    lines = F.transform(names, lambda k: F.concat(k, F.lit(": "), F.element_at(values, k)))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), text)


def live(files: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """The files whose head neither disables them nor lets them expire, with a limit the newest ones; ``files`` has path, text and modified."""
    got = files.withColumn("head", head(F.col("text"))).withColumn("body", body(F.col("text")))
    field = lambda k: F.try_element_at("head", F.lit(k))
    off = F.coalesce(F.lower(field("disabled")).isin("true", "yes", "1"), F.lit(False))
    old = expired(F.try_to_timestamp(field("updated_at")), F.try_to_timestamp(field("created_at")), field("ttl_days").try_cast("int"), as_of)
    kept = got.where(~off & ~old)
    return kept if limit is None else kept.orderBy(F.col("modified").desc(), "path").limit(limit)
