"""Counts of search tokens, taken from whole Arrow batches."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestrata.functions.text import CJK
from lodestrata.runtime import extended, ship

#: Bytes of text that are worked on at once; arrays over them take some thirty times as much.
BLOCK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RUN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK) + "+")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``BLOCK`` bytes of text, one row at least, so that what a task holds doesn't grow with its batches."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        yield batch.slice(low, high - low)
        low = high


def batch_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``functions.text.tokens`` of a column, in no order, and the row of each; null has none."""
    raw, offsets = _bytes(texts)
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1]) & ~edge[:-1] if len(raw) else inside
    starts = np.flatnonzero(inside & ~before)
    owner = np.append(0, np.cumsum(inside & ~before))
    sizes = np.bincount(owner[1:][inside] - 1, minlength=len(starts)) if len(raw) else np.zeros(0, np.int64)
    cuts = np.append(0, np.cumsum(sizes))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(_LOWER[raw[inside]])])
    row = np.searchsorted(offsets, starts, "right") - 1
    more, more_row = [], []
    if (raw >= 0xE0).any():  # runs without spaces: characters and pairs
        for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, CJK), False).to_numpy(zero_copy_only=False)):
            for run in _RUN.findall(texts[int(i)].as_py()):
                found = [*run, *map("".join, zip(run, run[1:]))]
                more += found
                more_row += [int(i)] * len(found)
    if more:
        words = pa.concat_arrays([words, pa.array(more, pa.large_string())])
        row = np.append(row, more_row)
    return words, row


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each text and each of its different tokens: the other columns, ``length``, ``term`` and ``tf``."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, text) for b in batches):
            words, row = batch_tokens(batch.column(text))
            coded = words.dictionary_encode()
            n = max(1, len(coded.dictionary))
            key, tf = np.unique(row.astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
            at, term = np.divmod(key, n)
            length = np.bincount(row, minlength=batch.num_rows)
            step = 1 << 20
            for low in range(0, len(key), step):
                part = slice(low, low + step)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at[part])) for c in keep), pa.array(length[at[part]].astype(np.int32)), coded.dictionary.take(pa.array(term[part])).cast(pa.string()), pa.array(tf[part].astype(np.int32))], [*keep, "length", "term", "tf"])

    return docs.mapInArrow(run, extended(docs.select(*keep).schema, "length int, term string, tf int"))


def frequencies(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Each row with ``length``, the number of its tokens, and ``tf``, how often each of some tokens is among them, in place of the text."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.large_string())
        for batch in itertools.chain.from_iterable(slices(b, text) for b in batches):
            words, row = batch_tokens(batch.column(text))
            place = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy(zero_copy_only=False)
            hit = place >= 0
            tf = np.bincount(row[hit].astype(np.int64) * len(terms) + place[hit], minlength=batch.num_rows * len(terms))
            cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(terms))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))], [*keep, "length", "tf"])

    return docs.mapInArrow(run, extended(docs.select(*keep).schema, "length int, tf array<int>"))
