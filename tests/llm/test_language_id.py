from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language_id as R

N = R.ORDER


def plain_words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in text or "":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [w.lower() for w in [*out, *[word] * bool(word)]]


def plain_model(texts: list[str], alphabet: int):
    """Interpolated Kneser-Ney by dictionaries; returns p(sign, context)."""
    counts = {N: collections.Counter()}
    for t in texts:
        for w in plain_words(t):
            s = R.START * (N - 1) + w + R.END
            counts[N].update(s[i : i + N] for i in range(len(s) - N + 1))
    for k in range(N - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    total = {k: collections.Counter() for k in counts}
    kinds = {k: collections.Counter() for k in counts}
    for k, grams in counts.items():
        for g, n in grams.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
    few = {k: (sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for k, c in counts.items()}
    d = {k: a / (a + 2 * b) if a and b else 0.5 for k, (a, b) in few.items()}

    def p(sign: str, context: str) -> float:
        k = len(context) + 1
        below = p(sign, context[1:]) if context else 1 / alphabet
        if not total[k][context]:
            return below
        return (max(counts[k][context + sign] - d[k], 0) + d[k] * kinds[k][context] * below) / total[k][context]

    return p


def rows_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").select("doc_id", "text", "lang")


def learnt(rows) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("aside", R._aside()).collect():
        if r["lang"] is not None and r["text"] is not None and not r["aside"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            out.setdefault(r["lang"], []).append(r["text"])
    return out


def test_entropies_are_those_of_dictionaries(spark, sf):
    rows = rows_of(spark, sf)
    models = R.learn(rows)
    texts = learnt(rows)
    assert models.languages == sorted(texts)
    signs = {c for own in texts.values() for t in own for w in plain_words(t) for c in w} | {R.END}
    plain = {lang: plain_model(own, len(signs) + 1) for lang, own in texts.items()}
    some = [r["text"] for r in rows.where("doc_id % 20 = 1").collect()] + ["Zebra ЖЖ 漢字 naïve", "a", "7 up"]
    raw, offsets = R.X.utf8(R.pa.array(some))
    nats, size, letter = R.entropies(raw, offsets, models)
    assert letter.all()
    for i, t in enumerate(some):
        seqs = [R.START * (N - 1) + w + R.END for w in plain_words(t)]
        assert size[i] == sum(len(s) - N + 1 for s in seqs)
        for j, lang in enumerate(models.languages):
            want = -sum(math.log(plain[lang](s[k], s[k - N + 1 : k])) for s in seqs for k in range(N - 1, len(s))) / size[i]
            assert nats[i, j] == pytest.approx(want, abs=1e-9)


def test_pruned_models_sum_to_one(spark, sf):
    models = R.learn(rows_of(spark, sf), max_grams=2000)
    assert all(len(level.runs) <= 2000 // len(models.languages) for own in models.levels for level in own)
    signs = sorted({c for r in rows_of(spark, sf).collect() for w in plain_words(r["text"]) for c in w} | {R.END})
    for own in models.levels:
        for context in ("\x02\x02\x02\x02", "tion", "zzzz"):
            grams = np.array([[ord(c) for c in context + s] for s in signs], np.uint32)
            here = R._gram_hashes(grams)
            back = [R._gram_hashes(grams[:, at:-1])[-1] for at in range(N - 1, -1, -1)]
            total = np.exp(R.log_probabilities(own, here, back, models.log_unknown)).sum()
            assert total == pytest.approx(1, abs=0.02)  # signs held out have the rest


def test_held_out_rows_and_others(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = R.identified_documents(rows).join(rows, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score", "rejected").toPandas()
    assert got["ok"].mean() > 0.98 and got["score"].between(0, 1).all() and got["rejected"].mean() < 0.1


def test_learns_from_training_rows_only(spark, sf):
    rows = rows_of(spark, sf)
    other = rows.withColumn("lang", F.when(R.is_held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, R.identified_documents(r).collect())) for r in (rows, other))
    assert a == b and "xx" not in {r[2] for r in b}


def test_unusual_rows(spark, sf):
    base = rows_of(spark, sf)
    long_text = "der Hund und die Katze " * 60_000
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !?", "fr"), (None, "Haus und Hof", None), (-4, long_text, None), (-4, long_text, None), (-5, "ß", None), (-6, "́", None)], "doc_id long, text string, lang string")
    rows = base.unionByName(odd).withColumn("score", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("gram", F.lit("g"))
    models = R.calibrate(rows, R.learn(rows))
    got = [r.asDict() for r in R.identify(rows, models).where("doc_id < 0 or doc_id is null").collect()]
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (-1, -2, -3, -6)} == {-1: "und", -2: "und", -3: "und", -6: "und"}
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["lang_pred"] == "und")
    twice = [r for r in got if r["doc_id"] == -4]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n"] == 1
    assert all(r["lang_pred"] in models.languages for r in got if r["doc_id"] in (None, -4, -5))


def test_nothing_learnt(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {tuple(r)[2:4] for r in R.identified_documents(rows).collect()} == {("und", 0.0)}
    assert R.identified_documents(rows.limit(0)).count() == 0


def test_one_language(spark):
    rows = spark.createDataFrame([(i, "one two three", "en") for i in range(60)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in R.identified_documents(rows).collect()} == {"en"}


def test_all_rows_aside_calibrate(spark, monkeypatch):
    rows = spark.range(240_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one two").otherwise("eins zwei").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    used = []
    monkeypatch.setattr(R, "calibrated", lambda z, y, times=None: used.append(len(y) if times is None else times.sum()) or (1.0, 0.0))
    models = R.calibrate(rows, R.learn(rows))
    aside = rows.where(~R.is_held_out() & R._aside()).count()
    assert aside > 12_000 and used == [aside]
    assert all(limit >= 0 for limit in models.limits) and models.limits[0] < float("inf")


def test_more_runs_than_are_broadcast_are_judged_whole(spark, sf):
    rows = rows_of(spark, sf).unionByName(spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 !?", None), (-4, "Zebra ЖЖ 漢字 naïve", None), (None, "Haus", None)], "doc_id long, text string, lang string"))
    whole, tables = R.trained(rows), R.trained(rows, max_grams=2000)
    assert not whole.whole and len(tables.whole) == N and tables.languages == whole.languages
    assert max(len(level.runs) for own in tables.levels for level in own) < max(len(level.runs) for own in whole.levels for level in own)
    got, want = ({(r["doc_id"], r["text"]): r for r in R.identify(rows, m, detail=True).collect()} for m in (tables, whole))
    assert len(got) == rows.distinct().count() and got.keys() == want.keys()
    for key, r in want.items():
        assert (got[key]["lang"], got[key]["lang_pred"], got[key]["n_signs"], got[key]["rejected"]) == (r["lang"], r["lang_pred"], r["n_signs"], r["rejected"])
        assert [got[key][c] for c in ("cross_entropy", "score", "margin")] == pytest.approx([r[c] for c in ("cross_entropy", "score", "margin")], abs=1e-7, rel=1e-7)


def test_rows_aside_are_learnt_in_the_end(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"))
    rows = rows.withColumn("text", F.when(R._aside(), F.lit("zzz")).otherwise(F.col("text")))
    for models, known in ((R.learn(rows), False), (R.trained(rows), True)):
        here = R._gram_hashes(np.array([[2, 2, 2, 2, ord("z")]], np.uint32))
        assert (R._find(models.levels[0][N - 1].runs, here[N])[0] >= 0) == known
