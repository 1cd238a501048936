"""Embeddings made once for each text and model, kept in a table that is replaced at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.embedding import embedded
from lodestrata.sources.versions import Versions

#: Days after which an embedding is made again.
DAYS = 30
_SCHEMA = "model string, hash string, embedding array<float>, made timestamp"


@dataclass
class EmbeddingCache:
    """A cache below a path. ``embed`` adds a column ``embedding`` to a table with ``text``."""

    spark: SparkSession
    path: str
    model: str
    embed: Callable[[DataFrame], DataFrame] = embedded
    days: int | None = DAYS

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path)

    def entries(self, now) -> DataFrame:
        """What is cached and not older than ``days``, of all models; empty if nothing can be read."""
        held = self.versions.current()
        rows = self.spark.read.schema(_SCHEMA).parquet(f"{self.versions.folder(held[0])}/entries") if held else self.spark.createDataFrame([], _SCHEMA)
        return rows if self.days is None else rows.where(F.col("made") >= F.lit(now) - F.expr(f"INTERVAL {self.days} DAYS"))

    def embeddings(self, docs: DataFrame, now, text: str = "text") -> tuple[DataFrame, dict[str, int]]:
        """``docs`` with ``embedding``, and how many different texts were found and how many had to be embedded.

        Texts count by their hash, together with the model, so that vectors of different
        models never mix. Only missing texts are embedded, each once, and then published
        with the others that haven't expired. A null text counts as an empty one.
        """
        given = docs.withColumn("text_", F.coalesce(F.col(text), F.lit("")))
        hashed = given.withColumn("hash_", F.substring(F.sha2("text_", 256), 1, 32))
        alive = self.entries(now)
        own = alive.where(F.col("model") == self.model).select(F.col("hash").alias("hash_"))
        missing = hashed.select("hash_", F.col("text_").alias("text")).join(own, "hash_", "left_anti").dropDuplicates(["hash_"])
        made = self.embed(missing).select(F.lit(self.model).alias("model"), F.col("hash_").alias("hash"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(now).cast("timestamp").alias("made"))
        number = self.versions.next()
        folder = f"{self.versions.folder(number)}/entries"
        alive.unionByName(made).write.mode("overwrite").parquet(folder)
        entries = self.spark.read.schema(_SCHEMA).parquet(folder)
        self.versions.publish(number, {"model": self.model})
        self.versions.drop()
        mine = entries.where(F.col("model") == self.model).select(F.col("hash").alias("hash_"), "embedding", F.col("made"))
        wanted = hashed.select("hash_").distinct().join(mine.select("hash_", "made"), "hash_")
        before = own.distinct().join(hashed.select("hash_").distinct(), "hash_", "left_semi").count()
        out = hashed.drop("embedding").join(mine.drop("made"), "hash_").drop("hash_", "text_")
        return out, {"found": before, "embedded": wanted.count() - before}
