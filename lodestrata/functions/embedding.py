"""A hashing embedder that needs no model."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.counting import batch_tokens, slices
from lodestrata.runtime import extended, ship


def place_of(word: str, dimension: int) -> tuple[int, float]:
    """The slot and the sign of a token."""
    digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dimension, 1.0 if digest[4] % 2 == 0 else -1.0


def embedded(df: DataFrame, text: str = "text", dimension: int = 384) -> DataFrame:
    """Adds ``embedding``: each token adds a sign to a slot; the sum has length one, or zero without tokens."""
    ship(df.sparkSession)
    df = df.drop("embedding")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}

        def placed(word: str) -> tuple[int, float]:
            place = known.get(word)
            if place is None:
                place = place_of(word, dimension)
                if len(known) < 200_000:
                    known[word] = place
            return place

        for batch in itertools.chain.from_iterable(slices(b, text) for b in batches):
            words, row = batch_tokens(batch.column(text))
            coded = words.dictionary_encode()
            places = [placed(w) for w in coded.dictionary.to_pylist()]
            slot, sign = np.array([p for p, _ in places], np.int64), np.array([s for _, s in places])
            code = coded.indices.to_numpy()
            v = np.bincount(row.astype(np.int64) * dimension + slot[code], sign[code], batch.num_rows * dimension).reshape(-1, dimension)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            out = (v / np.where(norm > 0, norm, 1.0)).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimension), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), flat], [*names, "embedding"])

    return df.mapInArrow(run, extended(df.schema, "embedding array<float>"))
