"""Quality rules: fixed base rules, and a calibrated model over hashed n-grams.

The model is a logistic regression on the frequencies of hashed words, pairs of words and
character n-grams, trained on labelled quality rows. A second, one-dimensional fit on rows
kept aside turns its output into a probability. Documents are scored in Arrow batches by
sums over whole batches of bytes, and nothing is shuffled.

The training rows are a bounded sample: all labelled rows up to ``max_rows``, else those
with the smallest hash of doc_id; each is represented by its hashed frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textops as X
from lodestrata.llm.toxicity import sample
from lodestrata.runtime import extended, ship

_U = np.uint64
#: Hash places of each kind of n-gram: characters by 2, 3 and 4, words by 1 and 2.
BITS = 13
_CHARS, _WORDS = (2, 3, 4), (1, 2)
KINDS = len(_CHARS) + len(_WORDS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Model:
    """Weights of all hash places, the bias, and slope and offset of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.int64) + (kind << BITS)


def _grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hash places, and how many come before each text."""
    letters = np.flatnonzero((raw & 0xC0) != 0x80)
    before = np.searchsorted(letters, offsets)
    points = _code_points(raw, letters)
    for kind, n in enumerate(_CHARS):
        at = X.fitting(before, n)
        h = points[at]
        for i in range(1, n):
            h = (h * _U(0x9E3779B97F4A7C15)) ^ points[at + i]
        yield _place(X.mix(h), kind), np.searchsorted(at, before)
    h, before = X.word_hashes(raw, offsets)
    for kind, n in enumerate(_WORDS, len(_CHARS)):
        at, found = X.windows(h, before, n)
        yield _place(found, kind), np.searchsorted(at, before)


def _code_points(raw: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A number for each character: its UTF-8 bytes as one integer."""
    out = raw[letters].astype(_U)
    size = np.diff(np.append(letters, len(raw)))
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        out[more] |= raw[letters[more] + i].astype(_U) << _U(8 * i)
    return out


def frequencies(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, and the hash places of each text with their frequencies."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text"))
            places, shares = [], []
            for i in range(batch.num_rows):
                own = np.array([0, offsets[i + 1] - offsets[i]])
                at, f = [], []
                for found, _ in _grams(raw[offsets[i] : offsets[i + 1]], own):
                    p, n = np.unique(found, return_counts=True)
                    at.append(p), f.append(n / max(1, len(found)))
                places.append(np.concatenate(at).astype(np.int32)), shares.append(np.concatenate(f).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(places, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], [*keep, "places", "shares"])

    return docs.select(*keep, "text").mapInArrow(run, extended(docs.select(*keep).schema, "places array<int>, shares array<float>"))


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    parts = [c for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate([c.flatten().to_numpy() for c in parts]), np.concatenate([c.value_lengths().to_numpy() for c in parts]).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 3_000, epochs: int = 30, seed: int = 0) -> Model:
    """Fits model and calibration on labelled rows that aren't held out.

    Without rows of both classes every text gets the share of label 1 (0.5 of no rows).
    """
    got = frequencies(sample(docs, labels, label, max_rows), ["doc_id", "label_"]).toArrow().sort_by("doc_id")
    y = np.asarray(got.column("label_").to_numpy(), np.float64)
    n_places = KINDS << BITS
    base = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(base / (1 - base)))
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(n_places), bias, 1.0, 0.0)
    column, lengths = _flat(got.column("places"), np.int32)
    value, _ = _flat(got.column("shares"), np.float32)
    value = np.sqrt(value)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside = order[: len(y) // 5]
    fit = order[len(y) // 5 :]
    w = np.zeros(n_places)
    m, s, moment, step = np.zeros(n_places), np.zeros(n_places), [0.0, 0.0], 0

    def output(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = lengths[rows]
        at = np.repeat(cuts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        c, v, r = column[at], value[at], np.repeat(np.arange(len(rows)), size)
        return bias + np.bincount(r, w[c] * v, len(rows)), c, v, r

    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            z, c, v, r = output(rows)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            grad = np.bincount(c, g[r] * v, n_places) + 1e-5 * w
            step += 1
            rate = 0.03 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad**2
            w -= rate * m / (np.sqrt(s) + 1e-8)
            moment = [0.9 * moment[0] + 0.1 * g.sum(), 0.999 * moment[1] + 0.001 * g.sum() ** 2]
            bias -= rate * moment[0] / (np.sqrt(moment[1]) + 1e-8)
    slope, offset = calibrated(np.concatenate([output(p)[0] for p in np.array_split(aside, max(1, len(aside) // 256))]) if len(aside) else np.zeros(0), y[aside])
    return Model(w.astype(np.float32), float(bias), slope, offset)


def calibrated(z: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the probability, by Newton steps on softened labels; ``times`` is how often a row counts, once without it."""
    w = np.ones(len(y)) if times is None else times
    total, positive = w.sum(), (w * y).sum()
    if not 0 < positive < total:
        return 1.0, 0.0
    t = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (p - t), w * (p * (1 - p) + 1e-9)
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [(g * z).sum(), g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _model_output(raw: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """w . sqrt(frequencies) for each text of a block."""
    n = len(offsets) - 1
    z = np.full(n, model.bias)
    rows = np.arange(n)
    for places, before in _grams(raw, offsets):
        size = np.diff(before)
        if not len(places):
            continue
        key = np.repeat(rows, size) * (KINDS << BITS) + places
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(first, len(key)))
        row, place = np.divmod(key[first], KINDS << BITS)
        z += np.bincount(row, model.weights[place] * np.sqrt(times / size[row]), n)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -500, 500)))


def _base(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text of a block."""
    def sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[at])

    h, before = X.word_hashes(raw, offsets)
    n_words = np.diff(before)
    chars = sums(~_BLANK[raw] & ((raw & 0xC0) != 0x80), offsets)
    symbols = sums(_SYMBOL[raw], offsets)
    at, h = X.windows(h, before, 3)
    own = X.row_of(at, before)
    _, place, times = np.unique(X.mix(h + own.astype(_U) * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    hit = at[times[place] > 1] if len(at) else at
    cover = np.zeros(int(before[-1]), bool)
    for i in range(3):
        cover[hit + i] = True
    return n_words, chars, symbols, sums(cover, before)


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _has_word(x)]
    return len(lines) - len(set(lines))


def _has_word(line: str) -> bool:
    """Whether a line has a character other than space and tab to carriage return."""
    return bool(line.strip(" \t\n\v\f\r"))


def judge(docs: DataFrame, model: Model, threshold: float = 0.5, min_words: int = 50, max_repeats: int = 50) -> DataFrame:
    """Adds the base figures, ``base_failed``, ``probability`` and ``kept``.

    ``n_words``: runs of characters other than space and tab to carriage return;
    ``word_chars``: their code points; ``n_symbols``: characters of #*$%&|<>;
    ``n_dup_lines``: lines with a word that are equal to an earlier line;
    ``n_repeat_words``: words in three-word windows that the text has twice or more.
    A text fails the base rules if it has fewer than ``min_words`` words, or more than
    ``max_repeats`` per cent of them are repeated; it is kept if it doesn't and its
    probability of label 1 is at least ``threshold``. Null and empty texts have no words,
    so they fail. Rows are independent; other columns pass through, and columns named like
    the new ones are replaced. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(docs.schema, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text"))
            base, probability = [], []
            for low, high in X.blocks(offsets):
                own, part = offsets[low : high + 1] - offsets[low], raw[offsets[low] : offsets[high]]
                base.append(_base(part, own))
                probability.append(_model_output(part, own, shared.value))
            words, chars, symbols, repeats = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (zip(*base) if base else [()] * 4))
            p = np.concatenate(probability) if probability else np.zeros(0)
            lines = np.array([_repeated_lines(t or "") for t in batch.column("text").to_pylist()], np.int64)
            failed = (words < min_words) | (100 * repeats > max_repeats * words)
            made = [words, chars, symbols, lines, repeats, failed, p, ~failed & (p >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document with its base figures and verdict."""
    out = judge(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))
