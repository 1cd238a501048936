from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """Every document scored for every item."""
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(A_TO_Z)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for i, t in set(items):
        wanted.setdefault(i, collections.Counter()).update(TERM.findall((t or "").translate(A_TO_Z)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in terms.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    got = R.ranked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [(1, "red apple and green pear"), (2, "Red APPLE"), (2, "Red APPLE"), (3, None), (4, ""), (5, "!?-"), (None, "red pear"), (None, "red pear"), (6, "ärger Ärger pear"), (7, "pear " * 500 + "apple"), (8, "plum"), (9, "plum"), (10, "plum")]
ITEMS = [(1, "red pear, Red"), (2, "plum"), (3, None), (4, "..."), (5, "unheard of"), (None, "apple"), (1, "red pear, Red"), (6, "ärger"), (6, "pear")]


@pytest.mark.parametrize("k", [1, 2, 10])
def test_small_cases(spark, k):
    assert found(spark, DOCS, ITEMS, k) == plain(DOCS, ITEMS, k)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == [] == found(spark, DOCS, [])


def test_many_small_shards_and_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "SHARD_DOCS", 16)
    monkeypatch.setattr(R, "BLOCK_TERMS", 400)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, R.ranked_documents(docs, items).collect()), key=str)
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_intervals_leave_lists_unread():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(1, 900_000, 4000))[::-1] for _ in range(3)]
    docs = np.concatenate([rng.permutation(4000) for _ in lists]).astype(np.int32)
    impacts = np.concatenate(lists)
    weight = np.array([9000, 700, 20])
    exact = np.zeros(4000, np.int64)
    np.add.at(exact, docs, np.repeat(weight, 4000) * impacts)
    at = np.arange(3) * 4000
    which, score, read = R.resolved(at, at + 4000, weight, docs, impacts, 4000, 5, 0)
    assert (exact[which] == score).all() and set(np.argsort(-exact)[:5]) <= set(which)
    again, _, less = R.resolved(at, at + 4000, weight, docs, impacts, 4000, 5, int(exact.max()) + 1)
    assert not len(again) and less < read < 12_000


def test_length_factors_beyond_64_bits():
    length = np.array([10**9, 5], np.int64)
    assert R.length_factors(length, 10**10, 10**12).tolist() == [25 + 75 * 10**9 * 10**10 // 10**12, 25 + 75 * 5 * 10**10 // 10**12]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "x", 3), (2, "c d e", 2, "x", 3)], "doc_id long, text string, score int, term string, rank int")
    items = spark.createDataFrame([(1, "b", 5)], "item_id long, text string, weight int")
    assert [r["doc_id"] for r in R.ranked_documents(docs, items).collect()] == [1]


def test_a_shard_is_a_row_group_without_statistics(spark):
    import pyarrow.dataset as ds

    rows = spark.range(0, 40_000, 1, 1)  # batches of 10,000 rows in one task
    index = R.build(rows.select(rows["id"].alias("doc_id"), F.concat(F.lit("word "), "id").alias("text")))
    files = [f.metadata for f in ds.dataset([f.removeprefix("file://") for f in index.shards.inputFiles()]).get_fragments()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert max(m.num_rows for m in files) > 1 and all(g.num_rows == 1 for g in groups)
    assert not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))
