"""Stores of JSON files: arrays of records, session snapshots, and an index of sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.runtime import ship
from lodestrata.sources.versions import Versions

_SNAPSHOT = (
    "session_id string, summary string, title string, model string, message_count long, created_at double, updated_at double, "
    "messages array<struct<role: string, content: array<struct<type: string, text: string>>>>, _broken string"
)


def array_records(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, modified, at, record, reject): a row for each element of the JSON arrays below a folder.

    ``record`` is an object as JSON with sorted keys. What isn't one has a ``reject`` instead:
    ``no object`` for other elements, ``no list`` for files with another value (``at`` is
    null), ``no json`` for files that can't be read as JSON. An empty list has no rows, nor
    has an empty file, which the scan leaves out. A file is parsed by one task, as its format demands.
    """
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    value = json.loads(batch.column("content")[i].as_py().decode())
                    rows = [(n, json.dumps(x, sort_keys=True, ensure_ascii=False), None) if isinstance(x, dict) else (n, None, "no object") for n, x in enumerate(value)] if isinstance(value, list) else [(None, None, "no list")]
                except ValueError:  # no UTF-8 or no JSON
                    rows = [(None, None, "no json")]
                at = pa.array([i] * len(rows), pa.int64())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("path").take(at), batch.column("modificationTime").take(at), *columns], ["path", "modified", "at", "record", "reject"])

    return found.select("path", "modificationTime", "content").mapInArrow(run, "path string, modified timestamp, at long, record string, reject string")


def records(spark: SparkSession, folder: str, ddl: str, pattern: str = "*.json") -> DataFrame:
    """The objects of ``array_records`` as columns of a schema; fields that don't fit are null."""
    held = array_records(spark, folder, pattern).where("record IS NOT NULL")
    return held.select("path", "modified", "at", F.from_json("record", ddl).alias("r")).select("path", "modified", "at", "r.*")


def _parsed(files: DataFrame) -> DataFrame:
    text = F.make_valid_utf8(F.col("content").cast("string"))
    held = files.select("path", "modificationTime", F.from_json(text, _SNAPSHOT, {"columnNameOfCorruptRecord": "_broken"}).alias("s"))
    return held.where("s IS NOT NULL AND s._broken IS NULL").select("path", "modificationTime", "s.*")


def _listed(parsed: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)\.json$", 1)
    texts = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.trim(F.array_join(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")))
    first = F.get(F.filter(texts, lambda t: t != ""), F.lit(0))
    summary = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.substring(first, 1, 80), F.lit(""))
    return parsed.select(
        F.coalesce("session_id", F.regexp_replace(name, "^session-", "")).alias("session_id"),
        summary.alias("summary"),
        F.coalesce("message_count", F.greatest(F.size("messages"), F.lit(0)).cast("long")).alias("message_count"),
        F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("created_at", F.col("modificationTime").cast("double")).alias("created_at"),
        "path",
        "modificationTime",
    )


def sessions(spark: SparkSession, folder: str, limit: int | None = 20) -> DataFrame:
    """(session_id, summary, message_count, model, created_at) of the newest session files.

    The files are chosen by their time, from what the file system tells, and only as many
    are read as are needed for ``limit`` readable ones: the bound on the time is pushed into
    the scan. Files that can't be read as JSON are skipped. A summary is the given one, or
    80 characters of the first text of a user. ``latest.json`` counts if no other file has
    its session. Rows are the newest by created_at, then by session_id. Without a limit all
    files are read and all sessions given, in no order.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    named = found.where(F.col("path").rlike(r"/session-[^/]*\.json$"))
    asked, total = limit, None if limit is None else named.select("path").count()
    got = None if limit is not None else _listed(_parsed(named.select("path", "modificationTime", "content")))
    while got is None:
        bound = named.select("modificationTime").orderBy(F.col("modificationTime").desc()).limit(asked).agg(F.min("modificationTime").alias("t")).first()["t"]
        chosen = named.where(F.col("modificationTime") >= F.lit(bound)) if bound is not None else named.limit(0)
        own = _listed(_parsed(chosen.select("path", "modificationTime", "content")))
        if asked >= total or own.count() >= limit:
            got = own.orderBy(F.col("modificationTime").desc(), "path").limit(limit)
        asked *= 2
    latest = _listed(_parsed(found.where(F.col("path").endswith("/latest.json")).select("path", "modificationTime", "content")))
    latest = latest.join(got.select("session_id"), "session_id", "left_anti").withColumn("summary", F.when(F.col("summary") == "", "(latest session)").otherwise(F.col("summary")))
    both = got.unionByName(latest).drop("path", "modificationTime")
    return both if limit is None else both.orderBy(F.col("created_at").desc(), "session_id").limit(limit)


@dataclass
class SessionIndex:
    """What a list of sessions shows, kept beside their files: one row for each, replaced by id."""

    spark: SparkSession
    path: str
    schema: str = "session_id string, title string, message_count long, created_at double, updated_at double"

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path)

    def entries(self) -> DataFrame | None:
        """All rows of the index; None if there is none that can be read."""
        held = self.versions.current()
        return self.spark.read.schema(self.schema).parquet(f"{self.versions.folder(held[0])}/entries") if held else None

    def _publish(self, rows: DataFrame) -> None:
        number = self.versions.next()
        rows.select(*(f.split()[0] for f in self.schema.split(", "))).write.mode("overwrite").parquet(f"{self.versions.folder(number)}/entries")
        self.versions.publish(number, {})
        self.versions.drop()

    def upsert(self, rows: DataFrame) -> None:
        """Replaces sessions by id and adds new ones; of rows with one id the last updated counts."""
        last = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "title"))
        rows = rows.withColumn("last_", last).where("last_ = 1").drop("last_")
        held = self.entries()
        self._publish(rows if held is None else held.join(rows.select("session_id"), "session_id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def remove(self, ids: DataFrame) -> None:
        """Takes sessions out."""
        held = self.entries()
        if held is not None:
            self._publish(held.join(ids.select("session_id"), "session_id", "left_anti"))

    def newest(self, limit: int = 100, folder: str | None = None) -> DataFrame:
        """The sessions updated last; without an index, or with an empty one, those of the files below ``folder``."""
        held = self.entries()
        if folder and (held is None or held.isEmpty()):
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "session-*.json").load(folder)
            held = _parsed(found.select("path", "modificationTime", "content")).where("session_id <> ''").select(
                "session_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("summary"), F.lit("")).alias("title"), F.coalesce("message_count", F.greatest(F.size("messages"), F.lit(0)).cast("long")).alias("message_count"), F.coalesce("created_at", F.lit(0.0)).alias("created_at"), F.coalesce("updated_at", "created_at", F.lit(0.0)).alias("updated_at")
            )
        if held is None:
            held = self.spark.createDataFrame([], self.schema)
        return held.orderBy(F.coalesce("updated_at", F.lit(0.0)).desc(), "session_id").limit(max(1, limit))


def transcript(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(by, markdown): each conversation as Markdown, a heading for each turn and its text below, if it has any."""
    body = F.trim(F.coalesce(text, F.lit("")))
    part = F.concat(F.lit("\n## "), F.initcap(role), F.lit("\n"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""))
    listed = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), part.alias("part")))).alias("parts"))
    return listed.select(by, F.concat(F.lit("# Session Transcript\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"), F.lit("\n")).alias("markdown"))
