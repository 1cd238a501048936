"""Queries that run a stream over a given table to its end, and reads of nested data."""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.registry import query
from lodestrata.runtime import scratch, settle, table
from lodestrata.sources import ingest as I
from lodestrata.sources import message_bus as B
from lodestrata.streaming import keyed as K
from lodestrata.streaming import stateful as S


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    named = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet")
    return named.parquet(sf_dir)


def _drained(out: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what there is, and returns what it wrote."""
    spark, path = out.sparkSession, scratch(out.sparkSession, name)
    run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("t3_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def t3_stream_dedup(spark, sf_dir):
    once = S.first_seen(_stream(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "400 days")
    return _drained(once, "dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "t1_collect",
    """
SELECT user_id, count(*) AS n, min(ts) AS first FROM events WHERE ts > TIMESTAMP '2024-01-10' AND event_id NOT IN (SELECT event_id
FROM events WHERE event_type = 'error') GROUP BY user_id
""",
)
def t1_collect(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fresh, _ = S.new_items(events, events.where("event_type = 'error'"), dt.datetime(2024, 1, 10), "event_id", "ts")
    return fresh.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("t5_cursors", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def t5_cursors(spark, sf_dir):
    return S.cursors(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("s13_objects", "SELECT event_type, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type")
def s13_objects(spark, sf_dir):
    rows = I.objects_with(["K"])(table(spark, sf_dir, "events").select("event_type", "props"), "props")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "s5_plan",
    """
WITH a AS (SELECT doc_id::VARCHAR AS path, substr(sha256(text), 1, 32) AS hash FROM documents WHERE doc_id % 5 > 0),
b AS (SELECT doc_id::VARCHAR AS path, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE text END), 1, 32) AS hash
FROM documents WHERE doc_id % 5 < 4)
SELECT coalesce(a.path, b.path) AS path, coalesce(a.hash, b.hash) AS hash, CASE WHEN a.hash IS NULL THEN 'delete' WHEN b.hash IS NULL THEN 'insert' WHEN a.hash = b.hash THEN 'skip' ELSE 'update' END AS action
FROM a FULL JOIN b USING (path)
""",
)
def s5_plan(spark, sf_dir):
    docs, h = table(spark, sf_dir, "documents"), lambda c: F.substr(F.sha2(c, 256), F.lit(1), F.lit(32))
    path = F.col("doc_id").cast("string").alias("path")
    now = docs.where("doc_id % 5 > 0").select(path, h(F.col("text")).alias("hash"))
    old = F.when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.col("text"))
    state = docs.where("doc_id % 5 < 4").select(path, h(old).alias("hash"), F.lit("m").alias("metadata_hash"))
    return I.planned(now, state, "m")


@query(
    "s15_attributes",
    r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:html|meta|div)\s[^>]*>')) AS tag FROM pages)
SELECT regexp_extract(tag, '(?:lang|charset|class)="([^"]*)"', 1) AS value, count(*) AS n
FROM t WHERE regexp_matches(tag, '(?:lang|charset|class)="') GROUP BY 1
""",
)
def s15_attributes(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"<(?:html|meta|div)\s[^>]*>"), F.lit(0))).alias("tag"))
    found = tags.select(I.attributes(F.col("tag")).alias("a")).select(F.coalesce(*(F.try_element_at("a", F.lit(k)) for k in ("lang", "charset", "class"))).alias("value"))
    return found.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


def _in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Runs a stream over a table that grows part by part; for each it is started again from its checkpoint."""
    spark, path = parts[0].sparkSession, scratch(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        out = build(spark.readStream.schema(parts[0].schema).parquet(f"{path}/in"))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The turns of all conversations: the first two of each, and then the others."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("string").alias("size"))
    return [turns.where("turn < 2"), turns.where("turn >= 2")]


@query(
    "t4_recent",
    """
WITH RECURSIVE r AS (SELECT conv_id, role AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)),
f(conv_id, i, held, new) AS (SELECT conv_id, 1, [key], TRUE FROM r WHERE i = 1 UNION ALL
  SELECT r.conv_id, r.i, CASE WHEN list_contains(held, key) THEN held ELSE (list_append(held, key))[-1:] END, NOT list_contains(held, key) FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, count(*) AS n FROM f WHERE new GROUP BY conv_id
""",
)
def t4_recent(spark, sf_dir):
    """Turns whose role isn't that of the turn before: a dedup that remembers one key, over a restart."""
    parts = [p.dropDuplicates(["conv_id", "turn", "role"]) for p in _halves(spark, sf_dir)]
    out = _in_parts(parts, lambda s: K.recent_dedup(s, "conv_id", "role", "turn", cap=1), "recent")
    return out.groupBy("conv_id").agg(F.count("*").alias("n"))


@query(
    "t6_cold_start",
    """
WITH c AS (SELECT conv_id, turn, turn >= 2 AS late, min(turn >= 2) OVER (PARTITION BY conv_id) AS began FROM conversations)
SELECT conv_id, turn FROM c WHERE CASE WHEN conv_id % 2 = 0 THEN turn > conv_id % 4 ELSE late > began END
""",
)
def t6_cold_start(spark, sf_dir):
    """Half of the conversations have a cursor when the stream begins; of the others the first batch is a backlog."""
    start = settle(table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id", (F.col("conv_id") % 4).alias("turn")).distinct(), "cursors")
    return _in_parts(_halves(spark, sf_dir), lambda s: K.after_cursor(s, "conv_id", "turn", start), "cold").select("conv_id", "turn")


@query(
    "t7_queue",
    """
WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
d AS (SELECT *, max(ms - 3600000 * i) OVER (PARTITION BY user_id ORDER BY i) + 3600000 * i AS leaves FROM e)
SELECT user_id, event_id, leaves - ms AS waits FROM d WHERE leaves <= (SELECT max(ms) FROM e)
""",
)
def t7_queue(spark, sf_dir):
    """Events leave a queue of their user an hour apart; what is due when the stream has been read is out."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    middle = events.agg(F.expr("timestamp_millis(CAST((unix_millis(min(ts)) + unix_millis(max(ts))) / 2 AS BIGINT))")).first()[0]
    parts = [events.where(F.col("ts") < F.lit(middle)), events.where(F.col("ts") >= F.lit(middle))]
    out = _in_parts(parts, lambda s: K.paced(s, "user_id", "ts", "event_id", "event_type", 3_600_000, "0 seconds"), "queue")
    return out.select("user_id", F.col("id").alias("event_id"), (F.unix_millis("leaves") - F.unix_millis("arrived")).alias("waits"))


@query("s33_bus", "SELECT conv_id * 1000 + turn AS number, sha256(text) AS body_sha256, turn >= 2 AS second FROM conversations")
def s33_bus(spark, sf_dir):
    """Turns go over a bus in two parts; its consumer is started for each and reads every message once."""
    path, turns = scratch(spark, "bus"), table(spark, sf_dir, "conversations")
    last = turns.agg(F.max("conv_id")).first()[0] or 0
    number = F.col("conv_id") * 1000 + F.col("turn")
    for late, part in enumerate([turns.where("turn < 2"), turns.where("turn >= 2")]):
        B.publish(part, number + late * (last + 1) * 1000, F.coalesce("text", F.lit("")), f"{path}/in")
        out = B.consume(spark, f"{path}/in").withColumn("second", F.lit(bool(late)))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("name string, body string, second boolean").parquet(f"{path}/out")
    return got.select((F.split_part("name", F.lit("."), F.lit(1)).cast("long") % ((last + 1) * 1000)).alias("number"), F.sha2("body", 256).alias("body_sha256"), "second")
