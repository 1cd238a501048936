"""Toxicity scores by a factorization machine over hashed terms.

A linear model weighs each term by itself. The factorization machine also gives each term
a small vector, and adds the products of the vectors of all pairs of terms of a text, so it
learns that an insult weighs more where a group is mentioned. Terms are words and their
beginnings, hashed into a fixed number of places; no term is left out before training, as
one that says nothing by itself may do so in a pair. Regularisation keeps what doesn't
matter at zero.

Training rows are a bounded sample of the labelled rows: all of them up to ``max_rows``,
else those with the smallest hash of doc_id. Their hashed terms go to the driver, which
fits the machine. Scoring runs over all rows in Arrow batches and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textops as X
from lodestrata.runtime import extended, settle, ship

#: Places that terms are hashed into, as a power of two.
BITS = 18
#: Lengths in bytes of the beginnings of words that are terms.
_STEMS = (4, 6)
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEM = _U(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Machine:
    """bias, and for each place of a hashed term a weight and a vector of factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of letters: those of A to Z and of characters beyond ASCII that aren't punctuation."""
    inside = _LETTER[raw]
    for lead, follow, size in ((0xC2, range(0x80, 0xC0), 2), (0xE2, range(0x80, 0x82), 3), (0xE3, range(0x80, 0x81), 3)):
        at = np.flatnonzero(raw[:-1] == lead)
        at = at[np.isin(raw[at + 1], list(follow))]
        for i in range(size):
            inside[np.minimum(at + i, len(raw) - 1)] = False
    return inside


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places of the terms of each text, and how many come before each text.

    A word is a run of letters, without regard to the case of Latin ones.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends, before = X.runs(_letters(raw), offsets)
    total, first = X.sums(X.folded(raw), starts, ends, fold=True)
    size, row = ends - starts, X.row_of(np.arange(len(starts)), before)
    found = [(row, X.sealed(total[first + size] - total[first], size))]
    for k in _STEMS:
        some = np.flatnonzero(size >= k)
        found.append((row[some], X.sealed(total[first[some] + k] - total[first[some]], k) * _STEM))
    key = np.concatenate([r << BITS | (h >> _U(64 - BITS)).astype(np.int64) for r, h in found])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(offsets)) << BITS)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``terms``: the different places of each text's terms."""
    ship(docs.sparkSession)
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text"))
            for low, high in X.blocks(offsets):
                places, cuts = terms(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in keep), lists], [*keep, "terms"])

    return docs.select(*keep, "text").mapInArrow(run, extended(kept.schema, "terms array<int>"))


def is_held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label_) of at most ``max_rows`` labelled documents that aren't held out.

    Of several labels of a doc_id the smallest counts, and of several rows of a doc_id that
    with the smallest hash of its text; rows without doc_id or label aren't used. The chosen
    ids, whose number is bounded, are broadcast, so that no other text is shuffled.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    chosen = rows.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label_")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label_").alias("label_"))
    return once


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 12_000, rank: int = 8, epochs: int = 8, seed: int = 0) -> Machine:
    """Fits a machine on labelled rows.

    Null and empty texts are rows without terms. Repeated and contradicting rows are treated
    as in ``sample``. Extra columns aren't looked at. Without rows of both classes, and so
    for empty tables, the machine has no weights, and gives every text the share of label 1
    (0.5 of no rows).
    """
    got = settle(features(sample(docs, labels, label, max_rows), ["doc_id", "label_"]), "toxicity-sample")
    held = got.toArrow().sort_by("doc_id").combine_chunks()
    y = held.column("label_").to_numpy().astype(np.float32)
    base = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(base / (1 - base)))
    n = 1 << BITS
    if not 0 < y.sum() < len(y):
        return Machine(bias, np.zeros(n, np.float32), np.zeros((n, rank), np.float32))
    lists = held.column("terms").combine_chunks()
    column, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    return fit(column, np.append(0, np.cumsum(size)), y, n, rank, epochs, seed, bias)


class _Batch:
    """Some rows: their terms row by row, and the same in the order of terms."""

    def __init__(self, rows: np.ndarray, column: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> None:
        size = cuts[rows + 1] - cuts[rows]
        rows = rows[size > 0]
        size = cuts[rows + 1] - cuts[rows]
        self.y = y[rows]
        self.starts = np.cumsum(size) - size
        self.term = column[np.repeat(cuts[rows] - self.starts, size) + np.arange(int(size.sum()))]
        order = np.argsort(self.term, kind="stable").astype(np.int32)
        term = self.term[order]
        self.begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.used = term[self.begin]
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), size)[order]
        self.place = np.repeat(np.arange(len(self.begin), dtype=np.int32), np.diff(np.append(self.begin, len(term))))


def _beyond(total: np.ndarray, squares: np.ndarray, bar: float, epoch: int) -> np.ndarray:
    """What of a sum of gradients lies beyond ``bar`` times the spread that chance gives it.

    Chance pulls a term the same way in every epoch, as the rows are the same.
    """
    return np.sign(total) * np.maximum(np.abs(total) - bar * np.sqrt(squares * epoch), 0)


def fit(column, cuts, y, n, rank, epochs, seed, bias, batch=128, rate=1.0, bar=2.5, pair_bar=3.0) -> Machine:
    """Dual averaging of the gradients of the logistic loss, given the terms of each row.

    Weights and factors move by what of the sum of their gradients lies beyond chance; so a
    term whose gradients cancel out keeps its start, which is zero for weights and a small
    random vector for factors. In the end such vectors are set to zero.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    parts = [b for low in range(0, len(y), batch) if len((b := _Batch(order[low : low + batch], column, cuts, y)).y)]
    w, z, squares = (np.zeros(n, np.float32) for _ in range(3))
    start = rng.normal(0, 0.01, (rank, n)).astype(np.float32)
    v, pulls, spread = start.copy(), np.zeros((rank, n), np.float32), np.zeros((rank, n), np.float32)
    bias_squares = 1.0
    for epoch in range(1, epochs + 1):
        for at in rng.permutation(len(parts)):
            b = parts[at]
            out, sums = bias + np.add.reduceat(w[b.term], b.starts), []
            for k in range(rank):
                mine = v[k][b.term]
                sums.append(np.add.reduceat(mine, b.starts))
                out += 0.5 * (sums[k] ** 2 - np.add.reduceat(mine**2, b.starts))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - b.y).astype(np.float32)
            bias_squares += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / bias_squares**0.5
            used, sorted_g = b.used, g[b.row]
            z[used] += np.add.reduceat(sorted_g, b.begin)
            squares[used] += np.add.reduceat(sorted_g**2, b.begin)
            w[used] = -rate * _beyond(z[used], squares[used], bar, epoch) / (1 + np.sqrt(squares[used]))
            for k in range(rank):
                pull = sorted_g * (sums[k][b.row] - v[k][used][b.place])
                pulls[k][used] += np.add.reduceat(pull, b.begin)
                spread[k][used] += np.add.reduceat(pull**2, b.begin)
                v[k][used] = start[k][used] - rate * _beyond(pulls[k][used], spread[k][used], pair_bar, epoch) / (1 + np.sqrt(spread[k][used]))
    v[:, (v == start).all(0)] = 0
    return Machine(float(bias), w, np.ascontiguousarray(v.T))


def outputs(raw: np.ndarray, offsets: np.ndarray, machine: Machine) -> np.ndarray:
    """Scores from 0 to 1 of a block of texts."""
    places, cuts = terms(raw, offsets)
    active = (machine.weights[places] != 0) | (machine.factors[places] != 0).any(1)
    row = X.row_of(np.arange(len(places)), cuts)[active]
    places, n = places[active], len(offsets) - 1
    z = machine.bias + np.bincount(row, machine.weights[places], n)
    for v in machine.factors[places].T.astype(np.float64):
        z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v**2, n))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold, else 0).

    Null and empty texts have no terms and get the score of the bias alone. Rows are
    independent, so repeated rows get equal scores and null keys don't matter. Other
    columns pass through; columns named like the new ones are replaced. An empty table
    gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text"))
            parts = [outputs(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shared.value) for low, high in X.blocks(offsets)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, extended(docs.schema, "score double, predicted int"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    machine = train(docs, labels)
    return score(docs.select("doc_id", "text"), machine).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
