from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.functions import text as X
from lodestrata.functions.chunking import chunked, chunks
from lodestrata.functions.embedding import embedded, place_of
from lodestrata.operators import aggregates as A
from lodestrata.operators import conversation as C
from lodestrata.operators import dedup as D
from lodestrata.operators import merge as M
from lodestrata.operators import retrieval as R
from lodestrata.runtime import table
from lodestrata.sources import frontmatter as Fm
from lodestrata.sources import ingest as I
from lodestrata.streaming import stateful as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("Hello W_1", ["hello", "w_1"]),
    ("数据 ok", ["ok", "数", "据", "数据"]),
    ("云", ["云"]),
    ("", []),
])
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [
    ("薪资 25-40K·14薪", (25000, 40000, 14)),
    ("20-30K", (20000, 30000, 12)),
    ("1.5-2万/月", (15000, 20000, 12)),
    ("24-36万/年", (20000, 30000, 12)),
    ("8000-12000元", (8000, 12000, 12)),
    ("30K以上", (30000, 30000, 12)),
    ("面议", (None, None, None)),
])
def test_salary(spark, text, want):
    assert tuple(one(spark, X.salary(F.lit(text)))) == want


@pytest.mark.parametrize("text, want", [("3-5年经验", "3-5年"), ("3年以上经验", "3年以上"), ("经验不限", "不限"), ("校招", "应届"), ("x", None)])
def test_experience(spark, text, want):
    assert one(spark, X.experience(F.lit(text))) == want


def test_quartiles_of_three(spark):
    df = spark.createDataFrame([(32500.0,), (25000.0,), (40000.0,)], "v double")
    got = A.quantile_summary(df.withColumn("g", F.lit("x")), ["g"], "v").select("n", "least", "p25", "median", "p75", "most", "mean").first()
    assert tuple(got) == (3, 25000.0, 28750.0, 32500.0, 36250.0, 40000.0, 32500.0)


def test_quantiles_over_ranges(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(50))) for g in "aab" for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: tuple(r)[1:] for r in A.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q9": 0.9, "q0": 0.0, "q10": 1.0}).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g]
        assert got[g] == (len(values), *(pytest.approx(np.quantile(values, q)) for q in (0.25, 0.9, 0, 1)))
    assert set(got) == {"a", "b", "c"}
    assert A.exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    one_value = spark.range(5000).selectExpr("'x' AS g", "CAST(id % 2 AS DOUBLE) AS v")
    assert tuple(A.exact_quantiles(one_value, ["g"], "v", {"q": 0.4, "m": 0.5, "h": 0.75}).select("n", "q", "m", "h").first()) == (5000, 0.0, 0.5, 1.0)


def test_counts_of_tokens_without_making_them(spark):
    texts = ["The cat, the CAT_s the; théthe", "今天天气天天好 the 天", "", "a天b天天"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for token in ("the", "天", "天天", "天气", "cat"):
        rows = df.select(X.token_count("t"), F.size(X.tokens("t")), X.token_frequency("t", token), F.size(F.filter(X.tokens("t"), lambda x: x == token))).collect()
        assert all(r[0] == r[1] and r[2] == r[3] for r in rows)


def test_top_terms_of_each_text(spark):
    df = spark.createDataFrame([("b b a a cc 12 cc cc the x",), ("",), (None,), ("z1 z1",)], "t string")
    got = [r[0] for r in df.select(R.top_terms("t", 2, ["the"])).collect()]
    assert [[tuple(x) for x in (g or [])] for g in got] == [[(3, "cc")], [], [], [(2, "z1")]]


def test_most_shared_words_in_blocks(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A  b"), (3, None), (4, "x"), (5, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "b"), (3, None), (4, "y"), (1, "x")], "item_id long, text string")
    want = [(1, 1, 3), (1, 5, 3), (2, 1, 1), (2, 2, 1)]
    for block in (1, 100):
        assert sorted(map(tuple, R.most_shared(docs, items, 2, block).collect())) == want


def test_owned_by_family(spark):
    from lodestrata.operators.scoring import related

    wanted = spark.createDataFrame([(1, "x1"), (1, "y1"), (1, "z1"), (2, "x1")], "k int, v string")
    owned = spark.createDataFrame([(1, "x1"), (1, "y2"), (1, "x1"), (2, "y1")], "k int, v string")
    got = {(r["k"], r["v"]): r["state"] for r in related(wanted, owned, ["k"], "v", F.substr("v", F.lit(1), F.lit(1))).collect()}
    assert got == {(1, "x1"): "covered", (1, "y1"): "partial", (1, "z1"): "missing", (2, "x1"): "missing"}


def test_where_with_missing_keys(spark):
    df = spark.createDataFrame([("a", 5), ("b", None)], "k string, n int")
    ids = lambda w: [r["k"] for r in df.where(P.where(w)).orderBy("k").collect()]
    assert ids({"n": {"$ne": 5}}) == ["b"]
    assert ids({"n": {"$gt": 1}}) == ["a"]
    assert ids({"n": {"$in": 5}}) == []
    assert ids({"n": {"$nin": 5}}) == ["a", "b"]
    assert ids({"$or": []}) == []
    assert ids({"n": {"$odd": 1}}) == []
    assert ids({"n": {"$gt": True}}) == []
    assert ids({}) == ["a", "b"]


def test_glob(spark):
    names = spark.createDataFrame([("a.py",), ("ab.py",), ("a.txt",)], "n string")
    assert names.where(F.col("n").rlike(X.glob_pattern("?.py"))).count() == 1
    assert names.where(F.col("n").rlike(X.glob_pattern("*.py"))).count() == 2
    assert names.where(F.col("n").rlike(X.glob_pattern("[!b]*"))).count() == 3


def test_secrets_and_urls(spark):
    assert one(spark, X.secrets(F.lit('token = "abcdefghijklmnop"'))) == ["generic-secret"]
    ok = one(spark, X.https_url(F.lit("https://a.example.com/x?q=1#top"), ["example.com"]))
    assert (ok["ok"], ok["url"]) == (True, "https://a.example.com/x?q=1")
    for url, reason in [("http://example.com", "scheme"), ("https://u@example.com", "userinfo"), ("https://example.com:8443/", "port"), ("https://10.0.0.1/", "private"), ("https://other.net/", "domain"), ("https://example.com/?token=1", "secret"), ("", "blank")]:
        assert one(spark, X.https_url(F.lit(url), ["example.com"]))["reason"] == reason


def test_bm25_counts_repeated_query_words(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None)], "doc_id long, text string")
    once = {r["doc_id"]: r["score"] for r in R.bm25(docs, "red").collect()}
    twice = {r["doc_id"]: r["score"] for r in R.bm25(docs, "red red").collect()}
    idf = np.log(1 + (3 - 1 + 0.5) / 1.5)
    assert once == {1: round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3))), 6)}
    assert twice[1] == pytest.approx(2 * once[1], abs=2e-6)


def test_packing_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(i, c) for i, c in enumerate([50, 40, 60, 5])], "i int, c int")
    got = R.packed(hits.withColumn("g", F.lit(0)), 130, ["g"], F.col("c"), [F.col("i")]).orderBy("i").collect()
    assert [(r["i"], r["used"], r["truncated"]) for r in got] == [(0, 50, False), (1, 40, False), (2, 40, True)]
    small = R.packed(hits.withColumn("g", F.lit(0)), 100, ["g"], F.col("c"), [F.col("i")]).count()
    assert small == 2


def test_cosine_edges(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, R.cosine(a(1.0, 0.0), a(1.0, 0.0))) == 1.0
    assert one(spark, R.cosine(a(0.0, 0.0), a(1.0, 0.0))) == 0.0
    assert one(spark, R.cosine(a(1.0), a(1.0, 0.0))) == 0.0


def test_hash_embedding(spark):
    df = spark.createDataFrame([("red red blue",), ("",), (None,)], "text string")
    rows = [np.array(r["embedding"]) for r in embedded(df, dimension=64).collect()]
    want = np.zeros(64)
    for w in ("red", "red", "blue"):
        slot, sign = place_of(w, 64)
        want[slot] += sign
    assert np.allclose(rows[0], want / np.sqrt(want @ want), atol=1e-6)
    assert not rows[1].any() and not rows[2].any()


def test_chunks_keep_every_word_and_the_budget():
    text = "# One\n" + "\n\n".join(f"Sentence {i} has some words. And more of them." for i in range(200))
    got = chunks(text, 64, 8)
    assert all(n <= 64 and n == _counted(c) for c, n in got)
    joined = " ".join(c for c, _ in got).split()
    assert set(text.split()) <= set(joined)
    assert chunks("", 64) == chunks(None, 64) == chunks(" \n", 64) == []
    long = chunks("x1 " * 1000, 64, 8)
    assert all(n <= 64 and n == _counted(c) for c, n in long)
    assert sum(n for _, n in long) == 1000 + 8 * (len(long) - 1)


def _counted(text):
    return len(re.findall("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]|[A-Za-z0-9_]+", text))


def _plain_chunks(text, budget, overlap):
    """The same chunks by splitting strings again and again."""
    def parts(t, ways):
        if _counted(t) <= budget:
            return [t.strip()] if t.strip() else []
        if ways:
            return [p for x in re.split(ways[0], t) for p in parts(x, ways[1:])]
        at = [m.start() for m in re.finditer("[A-Za-z0-9_]+", t)]
        out, i = [], 0
        while True:
            out.append(t[at[i] if i else 0 : at[i + budget] if i + budget < len(at) else len(t)].strip())
            i += budget - overlap
            if i >= len(at) - overlap:
                return out

    out, held = [], []
    size = lambda xs: sum(map(_counted, xs))
    for p in parts(text or "", [r"(?m)(?=^#{1,6}\s)", r"\n\s*\n", "(?<=[。！？!?；;.])"]):
        if held and size(held) + _counted(p) > budget:
            out.append("\n\n".join(held))
            while held and size(held) > min(overlap, budget - _counted(p)):
                held.pop(0)
        held.append(p)
    return out + ["\n\n".join(held)] if held else out


def test_chunks_of_a_table_by_loops(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = {}
    for r in chunked(docs, budget=64, overlap=8).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk"], r["token_count"]))
    for r in docs.collect():
        want = _plain_chunks(r["text"], 64, 8)
        assert sorted(got.get(r["doc_id"], [])) == [(i, c, _counted(c)) for i, c in enumerate(want)]


def test_any_key_is_a_fold(spark):
    rows = [(0, 1, "a", "x"), (0, 2, "a", "y"), (0, 3, "b", "y"), (0, 4, None, "x"), (1, 5, "a", "x")]
    df = spark.createDataFrame(rows, "g int, seq int, k1 string, k2 string")
    # row 2 goes, so its key y isn't remembered and row 3 stays
    assert sorted(r["seq"] for r in D.any_key(df, ["k1", "k2"], "seq", ["g"]).collect()) == [1, 3, 5]


def test_merge_overlays_and_names_actions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (4, "d", 1)], "k int, name string, h int")
    new = spark.createDataFrame([(1, "", 2), (2, "B", 1), (3, "c", 1)], "k int, name string, h int")
    got = {r["k"]: (r["name"], r["h"], r["action"]) for r in M.merge(old, new, "k", "h").collect()}
    assert got == {1: ("a", 2, "update"), 2: ("B", 1, "skip"), 3: ("c", 1, "insert"), 4: ("d", 1, "keep")}
    with pytest.raises(ValueError):
        M.delete(old)


def test_sanitized_conversations(spark):
    rows = [
        (1, 0, "user", "hi", [], []), (1, 1, "assistant", "", ["t1"], []), (1, 2, "user", "", [], ["t1", "zz"]), (1, 3, "assistant", "", [], []), (1, 4, "assistant", "done", [], []),
        (2, 0, "user", "q", [], ["orphan"]), (2, 1, "assistant", "x", ["t2"], []), (2, 2, "assistant", "y", [], []), (2, 3, "user", "", [], ["t2"]), (2, 4, "assistant", "z", ["t3"], []),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, calls array<string>, results array<string>")
    got = {(r["conv_id"], r["turn"]): list(r["results"]) for r in C.sanitized(df).collect()}
    assert got == {(1, 0): [], (1, 1): [], (1, 2): ["t1"], (1, 4): [], (2, 0): [], (2, 2): []}


def test_heads_of_files(spark):
    text = F.lit("---\ntitle: \"A b\"\nttl_days: 3\n---\nBody\n")
    assert one(spark, Fm.head(text)) == {"title": "A b", "ttl_days": "3"}
    assert one(spark, Fm.body(text)) == "Body\n"
    assert one(spark, Fm.head(F.lit("---\ntitle: x\nno end"))) == {}
    files = spark.createDataFrame([
        ("a", "---\nupdated_at: 2024-01-01\nttl_days: 3\n---\nx", dt.datetime(2024, 1, 1)), ("b", "plain", dt.datetime(2024, 1, 2)), ("c", "---\ndisabled: true\n---\nx", dt.datetime(2024, 1, 3)),
    ], "path string, text string, modified timestamp")
    assert [r["path"] for r in Fm.live(files, F.lit(dt.datetime(2024, 2, 1)), 5).collect()] == ["b"]


def test_live_files_without_a_limit(spark):
    files = spark.range(100_100).select(F.col("id").cast("string").alias("path"), F.lit("plain").alias("text"), F.lit(dt.datetime(2024, 1, 2)).alias("modified"))
    assert Fm.live(files, F.lit(dt.datetime(2024, 2, 1))).count() == 100_100


def test_folder_ingestion(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nSome text here.")
    (tmp_path / "b.json").write_text('{"k": {"v": 1}, "list": [1, 2]}')
    (tmp_path / "c.html").write_text("<p>Hello &amp; bye</p><script>x</script>")
    (tmp_path / "d.bin").write_text("no")
    empty_state = spark.createDataFrame([], "path string, hash string, metadata_hash string")
    stored = spark.createDataFrame([], "path string, title string, chunk string, chunk_index int, token_count int")
    now = I.files(spark, str(tmp_path))
    chunks_, state, report = I.ingested(now, empty_state, stored, {"tag": "t"})
    assert {r["action"]: r["files"] for r in report.collect()} == {"insert": 3}
    texts = {r["path"].rsplit("/", 1)[1]: r["chunk"] for r in chunks_.collect()}
    assert texts["b.json"] == "k:\n  v: 1\nlist:\n  1\n  \n  2" and texts["c.html"] == "Hello & bye"
    state = spark.createDataFrame(state.collect(), state.schema)
    (tmp_path / "a.md").write_text("changed")
    (tmp_path / "c.html").unlink()
    plan = {r["path"].rsplit("/", 1)[1]: r["action"] for r in I.planned(I.files(spark, str(tmp_path)), state, state.first()["metadata_hash"]).collect()}
    assert plan == {"a.md": "update", "b.json": "skip", "c.html": "delete"}


def test_objects_and_attributes(spark):
    df = spark.createDataFrame([(1, '{"a": [{"Name": "x"}, {"b": {"name": "y"}}]}'), (2, "bad"), (3, None)], "id int, j string")
    got = [tuple(r) for r in I.objects_with(["name"])(df, "j").collect()]
    assert got == [(1, '{"Name": "x"}'), (1, '{"name": "y"}')]
    assert one(spark, I.attributes(F.lit('<a HREF="1" class="c" href="2">'))) == {"href": "2", "class": "c"}


def _stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def _drain(out, folder):
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.parquet(f"{folder}/out").collect()


def test_debounce_flushes_on_gap_and_mention(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("k", t(0), "a", False), ("k", t(1), "b", False), ("k", t(20), "c", False), ("k", t(21), "d", True), ("z", t(59), "e", True)]
    stream = _stream(spark, str(tmp_path), rows, "who string, ts timestamp, text string, named boolean")
    got = _drain(S.debounced(stream, "who", "ts", "text", "named", 10_000, "0 seconds"), str(tmp_path))
    assert sorted((r["who"], r["body"], r["why"]) for r in got) == [("k", "a\nb", "gap"), ("k", "c\nd", "mention"), ("z", "e", "mention")]


def test_bounded_dedup_forgets_the_oldest(spark, tmp_path):
    rows = [("k", i, v) for i, v in enumerate(["a", "b", "a", "c", "a"])][::-1]  # they come in another order
    stream = _stream(spark, str(tmp_path), rows, "who string, n int, id string")
    got = _drain(S.bounded_dedup(stream, "who", "id", "n", cap=2), str(tmp_path))
    assert sorted(r["n"] for r in got) == [0, 1, 3, 4]


def test_ties_are_decided_by_hash(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, "c")], "k int, n int, v string")
    once = [D.first_wins(df.repartition(n), ["k"], [F.col("n")]).first()["v"] for n in (1, 3, 5)]
    assert len(set(once)) == 1 and once[0] in "ab"


def test_incremental_items(spark):
    batch = spark.createDataFrame([Row(k="a", at="2"), Row(k="b", at="3"), Row(k="c", at="1")])
    fresh, mark = S.new_items(batch, spark.createDataFrame([Row(k="b")]), "1", "k", "at")
    assert [r["k"] for r in fresh.collect()] == ["a"] and mark == "2"


@pytest.mark.parametrize("expression, after, zone, want", [
    ("*/15 * * * *", "2024-01-01 10:07", "UTC", "2024-01-01 10:15"),
    ("0 9 * * 1", "2024-01-01 09:00", "UTC", "2024-01-08 09:00"),
    ("0 9 1 * 1", "2024-01-02 00:00", "UTC", "2024-01-08 09:00"),
    ("0 0 29 2 *", "2024-03-01 00:00", "UTC", "2028-02-29 00:00"),
    ("30 8 * * *", "2024-01-01 00:00", "Asia/Shanghai", "2024-01-01 00:30"),
    ("0 0 * * 7", "2024-01-01 00:00", "UTC", "2024-01-07 00:00"),
    ("0 0 31 2 *", "2024-01-01 00:00", "UTC", None),
    ("bad", "2024-01-01 00:00", "UTC", None), ("61 * * * *", "2024-01-01 00:00", "UTC", None), (None, "2024-01-01 00:00", "UTC", None),
])
def test_next_run(expression, after, zone, want):
    from lodestrata.functions.schedule import next_run

    got = next_run(expression, dt.datetime.fromisoformat(after), zone)
    assert (got and got.strftime("%Y-%m-%d %H:%M")) == want


def test_match_rubric(spark):
    from lodestrata.operators import scoring as S

    skills = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    n = lambda x: F.lit(x).cast("double")
    families = {"java": "jvm", "scala": "jvm"}
    assert one(spark, S.coverage(skills("java"), skills("java", "scala", "go"), families)) == pytest.approx(1.6 / 3)
    assert one(spark, S.coverage(skills(), skills(), families)) == 1.0
    assert one(spark, S.missing(skills("java"), skills("java", "scala", "go"), families)) == ["go"]
    assert [one(spark, S.experience_score(n(y), n(3), n(5))) for y in (1, 4, 7, 30, None)] == [50.0, 100.0, 90.0, 60.0, 70.0]
    assert [one(spark, S.education_score(F.lit(a), F.lit(b))) for a, b in ((2, 3), (3, 2), (1, 0), (0, 4))] == [50.0, 100.0, 100.0, 0.0]
    assert one(spark, S.education_score(F.lit(None).cast("int"), F.lit(2))) == 60.0
    assert one(spark, S.other_score(F.lit("x"), skills("x"), n(10), n(20), n(15), n(30))) == 100.0
    assert one(spark, S.other_score(F.lit("x"), skills(), n(None), n(None), n(15), n(30))) == 50.0
    assert [one(spark, S.advice(n(t), n(c), F.lit(m))) for t, c, m in ((90, 0.95, True), (90, 0.5, True), (90, 0.95, False), (50, 1.0, True))] == [S.SAFE, S.FIT, S.FIT, S.REACH]


def test_files_are_read_once_and_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"n{i}.{('md', 'MD', 'bin')[i % 3]}").write_text(f"text {i}")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    files = I.files(spark, f"file://{tmp_path}")
    assert "binaryFile" not in files._jdf.queryExecution().executedPlan().toString()
    assert len(files.inputFiles()) < 9 + 1 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert {(r["path"].rsplit("/", 1)[1], r["text"]) for r in files.collect()} == {(f"n{i}.{('md', 'MD')[i % 3]}", f"text {i}") for i in range(300) if i % 3 < 2}
