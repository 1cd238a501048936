"""A keyword index that lasts: postings as a Parquet table, dealt by term.

``postings`` has a folder for each segment and bucket of terms; within a file rows are
sorted by term, so a query lists the buckets of its words only and skips all row groups but
theirs. A term of very many documents is dealt to several files. Every refresh adds a
segment with the documents that are new or changed; of those that were replaced or are gone
the old postings are named in a table of dead ones. A manifest, published last, says which
segments count and how many tokens and documents there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.counting import postings
from lodestrata.functions.text import tokens
from lodestrata.operators.retrieval import PLACES, bm25_gain
from lodestrata.runtime import marked, settle
from lodestrata.sources.versions import Versions

#: Buckets of terms, and files that a bucket's postings are dealt to.
BUCKETS, SPREAD = 64, 4
#: Segments after which, or dead postings' share beyond which, all is written anew.
MOST_SEGMENTS, MOST_DEAD = 8, 0.5


@dataclass
class KeywordIndex:
    """An index below a path; ``key`` names the documents and is unique among them."""

    spark: SparkSession
    path: str
    key: str = "doc_id"

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path)

    @property
    def revision(self) -> int:
        """The published revision, 0 if there is none."""
        held = self.versions.current()
        return held[0] if held else 0

    def refresh(self, docs: DataFrame, text: str = "text", stamp: str | None = None) -> dict[str, int]:
        """Brings the index to the state of ``docs`` and returns how many documents were inserted, updated, deleted and skipped.

        Texts are compared by hash and only changed ones are counted again. ``stamp`` names
        the state of the source: if the index was made of that state, nothing is read. Null
        texts have no tokens but count as documents; of rows with one key any one counts.
        """
        held = self.versions.current()
        if held and stamp is not None and held[1].get("stamp") == stamp:
            return {"inserted": 0, "updated": 0, "deleted": 0, "skipped": held[1]["n"]}
        if held and (len(held[1]["segments"]) >= MOST_SEGMENTS or held[1]["dead"] > MOST_DEAD * max(1, held[1]["n"])):
            held = None  # compaction
        number = self.versions.next()
        folder, key = self.versions.folder(number), self.key
        given = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("text_"), F.xxhash64(text).alias("hash"))
        empty = self.spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, old_hash long, segment int")
        state = self.spark.read.parquet(f"{self.versions.folder(held[1]['state'])}/state").withColumnRenamed("hash", "old_hash") if held else empty
        plan = given.drop("text_").dropDuplicates([key]).join(state, given[key].eqNullSafe(state[key]), "full_outer").select(F.coalesce(given[key], state[key]).alias(key), "hash", "old_hash", "segment")
        action = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("hash").isNull(), "deleted").when(F.col("hash") == F.col("old_hash"), "skipped").otherwise("updated")
        plan = settle(plan.withColumn("action", action), "index-plan")
        report = {"inserted": 0, "updated": 0, "deleted": 0, "skipped": 0} | {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        if held and not report["inserted"] + report["updated"] + report["deleted"]:
            self.versions.publish(number, held[1] | {"stamp": stamp})
            return report
        fresh = plan.where("action IN ('inserted', 'updated')").select(F.col(key).alias("key_"), F.col("hash").alias("hash_"))
        changed = given.join(marked(settle(fresh, "index-fresh")), F.col(key).eqNullSafe(F.col("key_")) & (F.col("hash") == F.col("hash_"))).select(key, "text_")
        found = postings(changed, "text_").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).withColumn("part_", F.pmod(F.xxhash64(key), F.lit(SPREAD)))
        dealt = found.repartition("bucket", "part_").dropDuplicates(["bucket", "part_", "term", key]).sortWithinPartitions("bucket", "term", key)
        dealt.drop("part_").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        plan.where("action <> 'deleted'").select(key, "hash", F.when(F.col("action") == "skipped", F.col("segment")).otherwise(number).cast("int").alias("segment")).write.mode("overwrite").parquet(f"{folder}/state")
        gone = plan.where("action IN ('updated', 'deleted')").select(key, "segment")
        dead = gone.unionByName(self._dead(held[1])) if held and held[1]["dead"] else gone
        dead.write.mode("overwrite").parquet(f"{folder}/dead")
        manifest = {"stamp": stamp, "segments": [*(held[1]["segments"] if held else []), number], "state": number, "dead": self.spark.read.parquet(f"{folder}/dead").count()}
        total = self._postings(manifest, None).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).first()["t"]
        n = report["inserted"] + report["updated"] + report["skipped"]
        self.versions.publish(number, manifest | {"n": n, "tokens": total})
        return report

    def _dead(self, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.versions.folder(manifest['state'])}/dead")

    def _postings(self, manifest: dict, terms: list[str] | None) -> DataFrame:
        """Living postings, of some terms or of all."""
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment").isin(manifest["segments"]))
        if terms is not None:
            asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term")).select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct()
            rows = rows.where(F.col("bucket").isin([r[0] for r in asked.collect()]) & F.col("term").isin(terms))
        if manifest["dead"]:
            dead = marked(self._dead(manifest).select(F.col(self.key).alias("dead_"), F.col("segment").alias("dead_segment")))
            rows = rows.join(dead, F.col(self.key).eqNullSafe(F.col("dead_")) & (F.col("segment") == F.col("dead_segment")), "left_anti")
        return rows

    def bm25(self, query: str) -> DataFrame:
        """(key, score) of the documents that hold a query token, as ``operators.retrieval.bm25`` gives them; no text is read."""
        held = self.versions.current()
        wanted = self.spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
        terms = {r["term"]: r["times"] for r in wanted.collect()}  # as many rows as the query has words
        if held is None or not held[1]["n"] or not terms:
            return self.spark.createDataFrame([], f"{self.key} long, score double")
        manifest, mean = held[1], held[1]["tokens"] / held[1]["n"]
        hits = self._postings(manifest, list(terms))
        df = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}
        gain = F.lit(0.0)
        for term, times in terms.items():
            if term in df:
                gain = F.when(F.col("term") == term, bm25_gain(F.lit(manifest["n"]), F.lit(df[term]), F.col("tf"), F.col("length"), F.lit(mean or 1.0), times)).otherwise(gain)
        return hits.groupBy(self.key).agg(F.round(F.sum(gain), PLACES).alias("score"))
