"""Incremental ingestion of folders of documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.chunking import chunked
from lodestrata.runtime import extended, settle, ship, spread
from lodestrata.sources.document_sink import opened

#: Bytes of files that are handed on at once.
_BATCH = 8 << 20
SUFFIXES = (".md", ".txt", ".json", ".html", ".htm")


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out too."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of the files below a folder, at any depth.

    Tasks list the folders, those of one depth side by side; of all names the driver sees none.
    """
    ship(spark)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for batch in batches:
            for below in batch.column("below").to_pylist():
                found = [f for f in files.get_file_info(fs.FileSelector(root + below)) if not _hidden(f.base_name)]
                for i in range(0, len(found), 10_000):
                    some = found[i : i + 10_000]
                    names = pa.array([f"{below}/{f.base_name}" for f in some], pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array([f.type == fs.FileType.Directory for f in some], pa.bool_()), pa.array([f.mtime for f in some], pa.timestamp("us", "UTC"))], ["below", "is_folder", "modified"])

    depth, out = spark.createDataFrame([("",)], "below string"), None
    while True:
        got = settle(depth.mapInArrow(entries, "below string, is_folder boolean, modified timestamp"), "names")
        own = got.where("NOT is_folder").select("below", "modified")
        out = own if out is None else out.unionByName(own)
        depth = got.where("is_folder").select("below")
        if depth.isEmpty():
            return out
        depth = spread(depth, "below")


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, text, hash, modified) of the files below a folder; bytes that are no UTF-8 are replaced.

    The files are read once, into a table that all who ask for their rows read. Their names
    are dealt to all tasks, which read them one by one; the driver holds none of them.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    names = listed(spark, folder).where(F.lower("below").rlike(f"({'|'.join(map(re.escape, suffixes))})$"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            low, held, size = 0, [], 0
            for i, below in enumerate(batch.column("below").to_pylist()):
                with store.open_input_file(root + below) as source:
                    held.append(source.read())
                size += len(held[-1])
                if size >= _BATCH or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, len(held)) for c in ("below", "modified")), pa.array(held, pa.binary())], ["below", "modified", "content"])
                    low, held, size = i + 1, [], 0

    found = spread(names, "below").mapInArrow(read, "below string, modified timestamp, content binary")
    # validated as text by Spark, which replaces what is no UTF-8
    rows = found.select(F.concat(F.lit(whole), "below").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.substr(F.sha2("content", 256), F.lit(1), F.lit(32)).alias("hash"), "modified")
    return settle(rows, "files")


def json_lines(value: object) -> list[str]:
    """key: value lines of nested JSON; what is below a key is indented by two blanks, items of a list stand apart by an empty line."""
    if isinstance(value, dict):
        out = []
        for key, held in value.items():
            if isinstance(held, (dict, list)):
                out += [f"{key}:", *("  " + line for line in "\n".join(json_lines(held)).splitlines())]
            else:
                out.append(f"{key}: {held}")
        return out
    if isinstance(value, list):
        blocks = [b for b in ("\n".join(json_lines(item)) for item in value) if b]
        return ["\n\n".join(blocks)] if blocks else []
    return [str(value)]


def json_texts(df: DataFrame, column: str) -> DataFrame:
    """A JSON column as lines of text; what is no JSON stays as it is, and null stays null."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(column).to_pylist():
                try:
                    out.append(raw if raw is None else "\n".join(json_lines(json.loads(raw))))
                except ValueError:
                    out.append(raw)
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(out, pa.string()))

    return df.mapInArrow(run, df.schema)


def with_text(found: DataFrame) -> DataFrame:
    """Texts of all kinds as plain text: HTML without tags, JSON as lines, others normalised."""
    path = F.lower("path")
    native = F.when(path.rlike(r"\.html?$"), X.html_text("text")).otherwise(X.normalized("text"))
    rest = found.where(~path.endswith(".json")).withColumn("text", native)
    return rest.unionByName(json_texts(found.where(path.endswith(".json")), "text"))


def planned(now: DataFrame, state: DataFrame, metadata_hash: str) -> DataFrame:
    """``action`` for each path: insert, update, skip, or delete for files that are gone.

    A file is skipped if neither its content nor the metadata given to it changed.
    """
    a = now.select("path", "hash")
    b = state.select("path", F.col("hash").alias("old"), F.col("metadata_hash").alias("old_meta"))
    both = a.join(b, "path", "full_outer")
    same = (F.col("hash") == F.col("old")) & (F.col("old_meta") == metadata_hash)
    action = F.when(F.col("hash").isNull(), "delete").when(F.col("old").isNull(), "insert").when(same, "skip").otherwise("update")
    return both.select("path", F.coalesce("hash", "old").alias("hash"), action.alias("action"))


def ingested(now: DataFrame, state: DataFrame, stored: DataFrame, metadata: dict[str, str], budget: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New versions of the chunks and of the state, and a report of the actions."""
    meta_hash = X.content_hash(F.lit(json.dumps(metadata, sort_keys=True, ensure_ascii=False)))
    meta = now.sparkSession.range(1).select(meta_hash.alias("h")).first()["h"]
    plan = planned(now, state, meta)
    changed = now.join(plan.where("action IN ('insert', 'update')").select("path", "action"), "path")
    extra = [F.lit(v).alias(k) for k, v in sorted(metadata.items())]
    fresh = chunked(with_text(changed.select("path", "text", "hash", "modified")).select("path", X.title("text").alias("title"), "text"), budget=budget, overlap=overlap)
    fresh = fresh.select("path", "title", "chunk", "chunk_index", "token_count", *extra)
    kept = stored.join(plan.where("action = 'skip'").select("path"), "path", "left_semi")
    chunks = kept.unionByName(fresh, allowMissingColumns=True)
    new_state = plan.where("action <> 'delete'").select("path", "hash", F.lit(meta).alias("metadata_hash"))
    report = plan.groupBy("action").agg(F.count("*").alias("files"))
    return chunks, new_state, report


def objects_with(keys: list[str]):
    """A function of a DataFrame and a JSON column: rows for every object at any depth that has one of the keys, outer ones first."""
    wanted = {k.lower() for k in keys}

    def find(df: DataFrame, column: str) -> DataFrame:
        ship(df.sparkSession)
        keep = [c for c in df.columns if c != column]

        def objects(value: object) -> Iterator[dict]:
            todo = [value]
            while todo:
                x = todo.pop()
                if isinstance(x, dict):
                    if wanted & {k.lower() for k in x}:
                        yield x
                    x = list(x.values())
                if isinstance(x, list):
                    todo += reversed(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, out = [], []
                for i, raw in enumerate(batch.column(column).to_pylist()):
                    try:
                        value = json.loads(raw) if raw else None
                    except ValueError:
                        continue
                    for found in objects(value):
                        at.append(i), out.append(json.dumps(found, ensure_ascii=False, sort_keys=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int32())) for c in keep), pa.array(out, pa.string())], [*keep, "object"])

        return df.mapInArrow(run, extended(df.select(*keep).schema, "object string"))

    return find


def attributes(tag: Column) -> Column:
    """Lower-cased names and values of a tag's attributes; of repeated names the last counts."""
    pairs = F.transform(F.regexp_extract_all(tag, F.lit(r'([A-Za-z_:][\w:.-]*)\s*=\s*"([^"]*)"'), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^\s=]+)", 1)).alias("key"), F.regexp_extract(x, '"([^"]*)"', 1).alias("value")))
    # from the last one on, a name that was seen is left out
    none = F.array().cast("array<struct<key:string,value:string>>")
    unique = F.aggregate(F.reverse(pairs), none, lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.map_from_entries(unique)
