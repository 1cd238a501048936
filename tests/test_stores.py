from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.counting import frequencies, postings
from lodestrata.functions.embedding import embedded
from lodestrata.operators import retrieval as R
from lodestrata.plans.catalog import QUERIES
from lodestrata.sources import keyword_index as K
from lodestrata.sources.embedding_cache import EmbeddingCache
from lodestrata.sources.vector_store import VectorStore
from lodestrata.sources.versions import Versions

TEXTS = ["The red RED fox_1", None, "", "日本語 text 日本", "é-x  y", "a" * 5000 + " b", "漢"]


def test_counts_are_those_of_tokens(spark):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, other string")
    want = sorted((r["doc_id"], r["t"], r["n"]) for r in df.select("doc_id", F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n")).collect())
    got = postings(df).collect()
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in got) == want and {r["other"] for r in got} == {"own"}
    sizes = {r["doc_id"]: r["n"] for r in df.select("doc_id", F.size(X.tokens(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    rows = frequencies(df, ["red", "日本", "none"]).collect()
    assert {r["doc_id"]: r["length"] for r in rows} == sizes
    assert {r["doc_id"]: list(r["tf"]) for r in rows if any(r["tf"])} == {0: [2, 0, 0], 3: [0, 2, 0]}
    assert postings(df.limit(0)).count() == 0 == frequencies(df.limit(0), ["a"]).count()


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/store")
    assert v.current() is None and v.next() == 1
    v.publish(1, {"n": 1})
    v.publish(2, {"n": 2})
    assert v.current() == (2, {"n": 2})
    with pytest.raises(FileExistsError):
        v.publish(2, {"n": 3})
    (tmp_path / "store/manifest-00000003.json").write_text("{broken")
    assert v.current() == (2, {"n": 2}) and v.next() == 4
    v.publish(4, {"n": 4})
    v.drop(keep=1)
    assert v.numbers() == [4]


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_index_follows_its_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_SEGMENTS", 4)
    index = K.KeywordIndex(spark, f"file://{tmp_path}/index")
    assert index.bm25("red").count() == 0 and index.revision == 0
    rows = {i: f"red {'fox ' * (i % 4)}{'hen' if i % 3 else 'red'}" for i in range(40)} | {98: None, 99: ""}
    make = lambda: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert index.refresh(make()) == {"inserted": 42, "updated": 0, "deleted": 0, "skipped": 0}
    assert scores(index.bm25("red fox fox")) == scores(R.bm25(make(), "red fox fox"))
    for step in range(5):
        rows[step] = f"new fox {step}"
        rows[100 + step] = "hen hen"
        del rows[20 + step]
        report = index.refresh(make())
        assert report["deleted"] == 1 or report["inserted"] == len(rows)  # the latter when all is written anew
        for query in ("red fox", "hen", "new 3", "none"):
            assert scores(index.bm25(query)) == scores(R.bm25(make(), query))
    held = index.revision
    assert index.refresh(make())["skipped"] == len(rows) and scores(index.bm25("fox")) == scores(R.bm25(make(), "fox"))
    assert index.revision == held + 1


def test_stamp_skips_and_plans_of_searches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "hen"), (2, "hen")], "doc_id long, text string")
    index = K.KeywordIndex(spark, f"file://{tmp_path}/index")
    index.refresh(docs, stamp="a")
    assert index.refresh(docs.limit(0), stamp="a")["skipped"] == 2 and index.revision == 1
    plan = index.bm25("red fox")._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "PartitionFilters" in plan and "PushedFilters" in plan and "In(term" in plan
    assert index.refresh(docs.limit(0), stamp="b")["deleted"] == 2 and index.bm25("fox").count() == 0


def test_what_a_dead_writer_left_is_not_seen(spark, tmp_path):
    index = K.KeywordIndex(spark, f"file://{tmp_path}/index")
    index.refresh(spark.createDataFrame([(1, "red fox")], "doc_id long, text string"))
    want = scores(index.bm25("fox"))
    postings(spark.createDataFrame([(9, "fox fox")], "doc_id long, text string")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(K.BUCKETS)).cast("int")).write.partitionBy("bucket").parquet(f"file://{tmp_path}/index/postings/segment=2")
    assert scores(index.bm25("fox")) == want


def brute(vectors: dict, queries: dict, k: int) -> dict:
    unit = lambda v: np.array(v) / (np.sqrt(np.dot(v, v)) or 1)
    ids = sorted(vectors)
    m = np.array([unit(vectors[i]) for i in ids])
    return {q: sorted((-round(float(s), 6), i) for s, i in zip(m @ unit(v), ids))[:k] for q, v in queries.items()}


def test_recall_of_the_store(spark):
    got = QUERIES["s8_store"](spark, "/root/testdata/sf0.01").collect()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()}
    want = brute(rows, {i: v for i, v in rows.items() if i % 50 == 0}, 10)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    recall = np.mean([(q, i) in found for q, hits in want.items() for _, i in hits])
    assert recall >= 0.95 and len(got) == 10 * len(want)
    exact = {(q, i): -s for q, hits in want.items() for s, i in hits}
    assert all(r["score"] == pytest.approx(exact[r["query_id"], r["vec_id"]], abs=2e-6) for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 10
    vectors = {i: (centres[i % 40] + rng.normal(size=16)).tolist() for i in range(2000)}
    store = VectorStore(spark, f"file://{tmp_path}/s")
    manifest = store.save(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), model="m")
    assert manifest["probes"] < manifest["cells"] / 2 and manifest["model"] == "m"
    queries = {i: vectors[i] for i in range(0, 2000, 50)}
    df = spark.createDataFrame(list(queries.items()), "query_id long, embedding array<double>")
    want = brute(vectors, queries, 10)
    found = {(r["query_id"], r["vec_id"]) for r in store.search(df).collect()}
    assert np.mean([(q, i) in found for q, hits in want.items() for _, i in hits]) >= 0.95
    every = {(r["query_id"], r["rank"]): r["vec_id"] for r in store.search(df, probes=manifest["cells"]).collect()}
    assert every == {(q, n + 1): i for q, hits in want.items() for n, (_, i) in enumerate(hits)}
    plan = store.search(df.limit(1), probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_store_with_unusual_rows(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/s")
    assert store.load().count() == 0 and store.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [])]
    store.save(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert store.load().count() == 9
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0]), (3, None)], "query_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in store.search(asked, k=3, probes=9).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (1, 7, 1.0), (1, 7, 1.0)]
    store.save(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert store.load().count() == 0 and store.search(asked).count() == 0
    (tmp_path / "s/manifest-00000002.json").write_text("[]")
    assert store.load().count() == 9  # what can't be read isn't there


def test_cache_embeds_what_is_missing(spark, tmp_path):
    calls = []

    def embed(df):
        out = embedded(df, dimension=8)
        calls.append(out)
        return out

    day = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, "red", "x"), (2, "red", "y"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, embedding string")
    cache = EmbeddingCache(spark, f"file://{tmp_path}/c", "m", embed)
    out, counts = cache.embeddings(docs, day)
    assert counts == {"found": 0, "embedded": 2} and out.count() == 4
    want = {r["doc_id"]: r["embedding"] for r in embedded(docs.drop("embedding").fillna({"text": ""}), dimension=8).collect()}
    assert {r["doc_id"]: r["embedding"] for r in out.collect()} == want
    _, counts = cache.embeddings(docs, day + dt.timedelta(days=30))
    assert counts == {"found": 2, "embedded": 0} and calls[-1].count() == 0
    assert EmbeddingCache(spark, cache.path, "other", embed).embeddings(docs, day)[1] == {"found": 0, "embedded": 2}
    assert cache.embeddings(docs, day + dt.timedelta(days=31))[1] == {"found": 0, "embedded": 2}
    assert cache.embeddings(docs.limit(0), day)[1] == {"found": 0, "embedded": 0}


def test_tokens_are_counted_in_bounded_blocks(spark, monkeypatch):
    import pyarrow as pa

    from lodestrata.functions import counting

    texts = ["red fox 日本語", None, "", "red " * 50, "fox"] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(counting, "BLOCK", 300)
    parts = list(counting.slices(batch, "text"))
    assert pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
    assert len(parts) > 20 and all(sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 300 or p.num_rows == 1 for p in parts)
    for part in parts:
        words, row = counting.batch_tokens(part.column("text"))
        got = sorted(zip(row.tolist(), words.to_pylist()))
        want = [(i, w) for i, t in enumerate(part.column("text").to_pylist()) for w in (["red"] * 50 if (t or "").startswith("red red") else ["red", "fox", "日", "本", "語", "日本", "本語"] if (t or "").startswith("red fox") else (t or "").split())]
        assert got == sorted(want)
