from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import whitening as R


def plain(vectors: list[list[float]], k: int = 4):
    x = np.array([[int(np.floor(R.SCALE * c)) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x.astype(object) - s) ** 2).sum(1), ((x - s / n) @ q) / np.sqrt(values), values / (c * c).sum() * n


def check(spark, vectors, parts=1):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(parts)
    got = R.whitened_vectors(rows).orderBy("vec_id", "component").toPandas()
    n, deviation, white, explained = plain([[float(np.float32(c)) for c in v] for v in vectors])
    k = white.shape[1]
    mine = got["whitened"].to_numpy().reshape(-1, k)
    assert (got["n"] == n).all() and got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == deviation.tolist()
    np.testing.assert_allclose(mine * np.sign((mine * white).sum(0)), white, atol=1e-7)
    np.testing.assert_allclose(got["explained"].to_numpy().reshape(-1, k)[0], explained, rtol=1e-9)
    assert got["identity_error"].max() < 1e-8


def test_random_vectors(spark):
    rng = np.random.default_rng(3)
    check(spark, (rng.normal(size=(300, 12)) * np.arange(1, 13)).tolist(), 5)


def test_far_from_the_origin_with_copies(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(60, 6)) * [9, 8, 7, 3, 2, 1] + 3000).tolist()
    check(spark, base + [base[0]] * 200, 3)


def test_fewer_vectors_than_entries(spark):
    rng = np.random.default_rng(5)
    check(spark, (rng.normal(size=(6, 20)) * 3).tolist(), 2)


def test_two_entries_have_two_components(spark):
    check(spark, [[1.0, 2.0], [3.0, 5.0], [-4.0, 1.0], [0.0, 0.0]])


@pytest.mark.parametrize("dim,rows,spread", [(1, 5, 1), (3, 2, 1), (8, 200, 1), (16, 60, 1e6)])
def test_rank_one_updates(dim, rows, spread):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.normal(size=(rows, dim)) * spread * 30)
    if dim == 8:
        x[:, 1] = x[:, 0]
        x[100:] = x[100]
    one, other = R.Spectrum.empty(dim), R.Spectrum.empty(dim)
    for i, v in enumerate(x):
        (one if i % 3 else other).add(v)
    one.join(other)
    c = x - x.mean(0)
    scatter = c.T @ c
    assert one.n == rows and np.allclose(one.mean, x.mean(0))
    np.testing.assert_allclose(one.values, np.linalg.eigvalsh(scatter), atol=1e-12 * np.trace(scatter))
    np.testing.assert_allclose(one.vectors.T @ one.vectors, np.eye(dim), atol=1e-12)
    np.testing.assert_allclose(scatter @ one.vectors, one.vectors * one.values, atol=1e-11 * np.trace(scatter))


def test_spectra_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(R, "FAN_IN", 2)
    check(spark, np.random.default_rng(6).normal(size=(80, 4)).tolist(), 8)


def test_unusual_rows(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(size=(30, 3)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 0.0, 0.0]), (93, [float("-inf"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (None, good[0]), (0, good[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("mine")).withColumn("n", F.lit("old"))
    out = R.whitened(df, R.fit(df))
    got = out.select("vec_id", "x", "n", "component").collect()
    assert {r["vec_id"] for r in got} == {None, *range(30)} and len(got) == 32 * 3
    assert {(r["x"], r["n"]) for r in got} == {("mine", 30)}


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_components(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert R.whitened_vectors(df).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [-1e12]), (2, [0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in R.whitened_vectors(df).collect()}
    assert got == {0: None, 1: None, 2: 0}
