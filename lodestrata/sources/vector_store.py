"""A store of vectors dealt to cells, for searches that read a part of it.

Cells are learnt by k-means on a bounded sample of directions. Every row is written to the
folder of its nearest cell; a search reads the folders of the cells nearest to its vectors
and scores those rows exactly. How many cells are probed is measured when the store is
written: as few as give the wanted recall on a sample of its own rows, compared with all
rows. Exact search (``operators.retrieval.vector_search``) stays the default elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.retrieval import PLACES
from lodestrata.runtime import extended, ship
from lodestrata.sources.versions import Versions

#: Rows that cells are learnt from, at most, and cells, at most.
SAMPLE, MOST_CELLS = 20_000, 1024
#: Rows whose neighbours decide how many cells are probed, at most.
TRIAL = 200
#: Queries whose vectors are broadcast at once.
BLOCK = 4096
#: Files that a cell's rows are dealt to, so that a cell with very many rows isn't one task.
SPREAD = 4


def directions(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with vectors of ``dim`` finite entries, and these scaled to length one (zero stays zero)."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))
    fits = np.flatnonzero(np.diff(at) == dim)
    rows = flat[(at[fits][:, None] + np.arange(dim)[None, :])] if len(fits) else np.zeros((0, dim))
    sound = np.isfinite(rows).all(1)
    rows, fits = rows[sound], fits[sound]
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return fits, np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def learnt_cells(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Directions of cells: k-means by cosine, begun with rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


@dataclass
class VectorStore:
    """Vectors with keys below a path; a later ``save`` replaces all of them at once."""

    spark: SparkSession
    path: str
    key: str = "vec_id"
    vector: str = "embedding"

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path)

    def save(self, rows: DataFrame, model: str | None = None, recall: float = 0.95, k: int = 10) -> dict:
        """Writes a version and returns its manifest.

        Vectors that are null, have null or non-finite entries or another length than most
        are kept, in a cell of their own (-1) that searches don't read, as their cosine is 0.
        """
        ship(self.spark)
        number, key, vector = self.versions.next(), self.key, self.vector
        folder = self.versions.folder(number)
        first = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (first["dim"], first["count"]) if first else (0, 0)
        sample = rows.where(F.size(vector) == dim).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow().column(0).combine_chunks() if n else pa.array([], pa.list_(pa.float32()))
        _, found = directions(sample, dim)
        cells = int(min(MOST_CELLS, max(1, round(len(found) ** 0.5)), max(1, len(found))))
        centres = learnt_cells(found, cells) if len(found) else np.zeros((0, dim))
        shared = self.spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = directions(batch.column(vector), dim)
                cell = np.full(batch.num_rows, -1, np.int32)
                if len(shared.value) and len(at):
                    cell[at] = (unit @ shared.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        schema = extended(rows.drop("cell").schema, "cell int")
        celled = rows.drop("cell").mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64(key), F.lit(SPREAD)))
        celled.sortWithinPartitions("cell", key).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
        manifest = {"dim": dim, "cells": cells if len(found) else 0, "model": model, "centres": centres.tolist(), "probes": 0, "kind": rows.schema[key].dataType.simpleString(), "schema": schema.jsonValue()}
        self.versions.publish(number, manifest | {"probes": self._probes(folder, manifest, recall, k)})
        self.versions.drop()
        return self.versions.manifest(number)

    def _probes(self, folder: str, manifest: dict, recall: float, k: int) -> int:
        """The least number of probed cells with the wanted recall on a sample of rows."""
        if not manifest["cells"]:
            return 0
        held = self._read(folder, manifest)
        trial = held.where("cell >= 0").orderBy(F.xxhash64(self.key, F.lit("trial")), self.key).limit(TRIAL).select(F.col(self.key).alias("query_id"), self.vector)
        found = self._nearest(held, trial, manifest, manifest["cells"], k, keep_cell=True).toPandas()
        _, unit = directions(trial.orderBy("query_id").toArrow().column(self.vector).combine_chunks(), manifest["dim"])
        order = {q: i for i, q in enumerate(sorted(found["query_id"].unique()))}
        nearness = (-(unit @ np.array(manifest["centres"]).T)).argsort(1).argsort(1)
        needed = np.sort([nearness[order[q], c] + 1 for q, c in zip(found["query_id"], found["cell"])])
        # a margin, as the trial is a sample itself
        return int(min(manifest["cells"], needed[min(len(needed) - 1, int(np.ceil((recall + (1 - recall) / 2) * len(needed))))]))

    def _read(self, folder: str, manifest: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{folder}/vectors")

    def load(self) -> DataFrame:
        """All rows of the current version; an empty table if there is none that can be read."""
        held = self.versions.current()
        if held is None:
            return self.spark.createDataFrame([], f"{self.key} long, {self.vector} array<float>")
        return self._read(self.versions.folder(held[0]), held[1]).drop("cell")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, rank, key, score): for each row (query_id, vector) its k nearest of the probed cells.

        Scores are cosines; equal ones come by key. ``probes`` None: as many as were measured
        to be needed. Queries whose vector has another length have no rows.
        """
        held = self.versions.current()
        if held is None or not held[1]["cells"]:
            return self.spark.createDataFrame([], f"query_id long, rank int, {self.key} long, score double")
        rows = self._read(self.versions.folder(held[0]), held[1])
        return self._nearest(rows, queries, held[1], probes or held[1]["probes"], k)

    def _nearest(self, rows: DataFrame, queries: DataFrame, manifest: dict, probes: int, k: int, keep_cell: bool = False) -> DataFrame:
        ship(self.spark)
        key, vector, dim = self.key, self.vector, manifest["dim"]
        centres = np.array(manifest["centres"]).reshape(-1, dim)
        blocks = max(1, -(-queries.count() // BLOCK))
        out = None
        for number in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", vector).orderBy("query_id").toArrow().combine_chunks()
            at, unit = directions(part.column(vector).combine_chunks() if len(part) else pa.array([], pa.list_(pa.float32())), dim)
            ids = part.column("query_id").combine_chunks().take(pa.array(at)) if len(part) else pa.array([], pa.int64())
            near = (-(unit @ centres.T)).argsort(1)[:, :probes]
            asked: dict[int, list[int]] = {}
            for q, cells in enumerate(near.tolist()):
                for c in cells:
                    asked.setdefault(c, []).append(q)
            shared = self.spark.sparkContext.broadcast((ids, unit, asked))

            def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                yield from _best_of_cells(batches, *shared.value, key, vector, dim, k)

            kind = queries.schema["query_id"].dataType.simpleString()
            ddl = f"query_id {kind}, {key} {manifest['kind']}, score double, cell int"
            found = rows.where(F.col("cell").isin(sorted(asked))).select(key, vector, "cell").mapInArrow(score, ddl)
            out = found if out is None else out.unionByName(found)
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
        return out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", key, "score", *["cell"] * keep_cell)


def _best_of_cells(batches: Iterator[pa.RecordBatch], ids: pa.Array, unit: np.ndarray, asked: dict[int, list[int]], key: str, vector: str, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of this task for each query, of the cells that the query probes."""
    best: dict[int, list[tuple]] = {}
    for batch in batches:
        at, rows = directions(batch.column(vector), dim)
        cell, names = batch.column("cell").to_numpy()[at], batch.column(key).take(pa.array(at)).to_pylist()
        for c in np.unique(cell).tolist():
            own, want = np.flatnonzero(cell == c), np.array(asked.get(c, []), int)
            if not len(want):
                continue
            scores = np.round(rows[own] @ unit[want].T, PLACES)
            for q, column in zip(want.tolist(), scores.T):
                least = np.partition(column, len(column) - k)[len(column) - k] if len(column) > k else -2.0
                some = np.flatnonzero(column >= least)
                best[q] = sorted(best.get(q, []) + [(-float(column[i]), names[own[i]], c) for i in some])[:k]
    flat = [(q, *hit) for q, hits in best.items() for hit in hits]
    query = ids.take(pa.array([f[0] for f in flat], pa.int64()))
    yield pa.RecordBatch.from_pydict({"query_id": query, key: [f[2] for f in flat], "score": pa.array([-f[1] for f in flat], pa.float64()), "cell": pa.array([f[3] for f in flat], pa.int32())})
