"""Window dedup, line dedup and the n-gram join against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import line_dedup as L
from lodestrata.llm import ngram_join as J
from lodestrata.llm import substring_dedup as S


def words(t):
    return (t or "").encode().split()


def _windows(rows, size):
    own = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + size]) for w in own for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, own):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本"]
    base = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(6)]
    rows = []
    for i in range(120):
        kind = i % 5
        t = base[i % 6] if kind == 0 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)))
        if kind == 1:
            t = f"{t}\n{base[i % 6]} \t{t}"
        if kind == 2:
            t = f"{t} {t}"
        if kind == 3:
            w = base[i % 6].split(" ")
            w[rng.randrange(60)] = "changed"
            t = "  ".join(w)
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, base[0]), (203, base[0]), (None, base[1]), (204, " ".join(["x"] * 20000))]
    return rows


@pytest.mark.parametrize("size", [3, 35])
@pytest.mark.parametrize("chunk", [500, 1 << 20])
def test_windows(spark, texts, size, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = S.remove_repeats(docs, size).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in got), key=str) == _windows(texts, size)
    for r in got:  # intervals are maximal and in order
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_windows_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0
    extra = spark.createDataFrame([(1, "a b", 7, "k", 5)], "doc_id long, text string, removed int, other string, chunk_ int")
    got = S.remove_repeats(extra, 2)
    assert got.columns == ["doc_id", "text", "other", "chunk_", "n_words", "removed", "kept_text"] and got.first()["chunk_"] == 5


def test_packing_of_hashes():
    rng = np.random.default_rng(0)
    some = [np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)) for n in (1, 2, 1000)]
    for keys in (*some, np.array([0, 1, 1, 2**64 - 1], np.uint64), np.array([5, 5], np.uint64)):
        rest = rng.integers(0, 2**32, len(keys), dtype=np.uint32)
        got = S._unpack(S._pack(keys, rest))
        assert (got[0] == keys).all() and (got[1] == rest).all()


def test_hashes_that_differ_in_one_part_only():
    key, rest = np.array([7, 3, 7, 7, 3], np.uint64), np.array([1, 0, 2, 1, 0], np.uint32)
    order, fresh = S._ordered(key, rest)
    assert [(int(key[i]), int(rest[i])) for i in order] == [(3, 0), (3, 0), (7, 1), (7, 1), (7, 2)]
    assert fresh.tolist() == [True, False, True, False, True]


def test_words_that_collide_modulo_powers_of_two(spark):
    # a word of a and b and its complement: their polynomials are equal modulo 2^64 at any base
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} " + " ".join(f"w{i}" for i in range(34))), (2, f"{other} " + " ".join(f"w{i}" for i in range(34)))]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["removed"] for r in got] == [[], []]


def test_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 400)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, passage)] * 300 + [(7, passage)] * 300 + [(i, f"own words of document {i}") for i in range(100)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 35).collect()
    assert sorted((len(r["removed"]), r["kept_text"] == "") for r in got) == [(0, False)] * 100 + [(1, True)] * 600


def test_a_long_text_in_pieces(spark):
    from lodestrata.llm import textops as X

    text = " ".join(f"w{i % 777}" for i in range(5000)) + "\n" + "z" * 9000 + " end"
    raw, offsets = np.frombuffer(text.encode() * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    starts, ends, before = X.words(raw, offsets)
    for piece in (64, 5000, 1 << 20):
        h, at = X.word_hashes(raw, offsets, piece)
        assert (h == X.hashes(raw, starts, ends)).all() and (at == before).all()
    for k in (1, 3, 35):
        want = [sum(int(x) * pow(X.BASES[0], k - 1 - j, X.PRIME) for j, x in enumerate(h[i : i + k])) % X.PRIME for i in (0, 17)]
        assert X.rolled(h, k, X.BASES[0])[[0, 17]].tolist() == want


def _lines(rows, min_docs):
    where = collections.defaultdict(set)
    for n, t in enumerate(rows):
        for line in (t[1] or "").split("\n"):
            key = line.encode().strip().lower()
            if key:
                where[key].add(t)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where[x.encode().strip().lower()]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        pool = ["Common", " common\t", "COMMON ", "", "  ", "É", "é", f"own {i}", f"few {i // 3}", f"some {i % 40}"]
        rows.append((i, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))))
    return rows + [(400, None), (401, ""), (401, ""), (402, "common\n" * 500), (None, "common\nx")]


@pytest.mark.parametrize("min_docs", [1, 2, 10])
@pytest.mark.parametrize("batch", [7, 10000])
def test_common_lines(spark, lines, min_docs, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        docs = spark.createDataFrame(lines, "doc_id long, text string").repartition(5)
        got = L.dedup_lines(docs, min_docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=str) == _lines(lines, min_docs)


@pytest.mark.parametrize("batch", [7, 10000])
def test_first_lines_stay(spark, lines, batch):
    rows = [r for r in lines if r[0] is not None and r[0] != 401]
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            key = line.encode().strip().lower()
            if not key or key not in seen:
                kept.append(line)
            seen.add(key)
        want[i] = "\n".join(kept)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: r["kept_text"] for r in L.dedup_lines(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_lines_edges(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0
    extra = spark.createDataFrame([(1, "ab\na", 2, 3, 4, 5)], "doc_id long, text string, n_lines int, own_ int, bitmap_ int, doc_ int")
    assert L.dedup_lines(extra, 1).columns == ["doc_id", "text", "own_", "bitmap_", "doc_", "n_lines", "n_dropped", "kept_text"]
    assert L.dedup_lines(extra, 1, min_chars=2).select("n_lines", "n_dropped", "kept_text").first()[:] == (2, 1, "a")


def _joined(rows, n=5):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    held = collections.defaultdict(list)
    for (i, _), s in zip(rows, sets):
        held[s].append(i)
    links = {a: [b for b in held if b is not a and a and b and 5 * len(a & b) >= 4 * len(a | b)] for a in held}
    group = {}
    for a in held:
        if a not in group:
            reached, todo = {a}, [a]
            while todo:
                todo = [b for x in todo for b in links[x] if b not in reached and not reached.add(b)]
            for b in reached:
                group[b] = least(i for x in reached for i in held[x])
    return sorted(((i, least(held[s]), group[s], len(held[s]) - 1 + sum(len(held[b]) for b in links[s]), len(links[s])) for (i, _), s in zip(rows, sets)), key=str)


def test_join(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "RUN", 20)  # runs of the large group are dealt into pieces
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 80)))) for i in range(60)]
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    for i in range(60):  # a large group of near copies, many linked and some not
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"c{i}"
        rows.append((100 + i, "  ".join(w)))
    rows += [(200 + i, rows[i % 7][1]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one two"), (305, "one three")]
    # near copies and others without an id, and ids with several texts
    near = [" ".join(base[:k] + [f"d{k}"] + base[k + 1 :]) for k in range(5)]
    rows += [(None, near[0]), (None, near[1]), (None, "alone and without an id"), (5, near[2]), (5, near[3]), (5, rows[8][1]), (400, near[4]), (400, near[4])]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _joined(rows)


def test_long_runs_and_chains(spark, monkeypatch):
    # each text shares most of its words with the next ones only
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "RUN", 3)
    pool = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(pool[i * 4 : i * 4 + 100])) for i in range(60)] + [(900 + i, " ".join(pool[:150] + [f"z{i}"] * (i % 3))) for i in range(25)]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == _joined(rows)


def test_sets_of_colliding_words_differ(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y z u v"), (2, f"{other} x y z u v"), (3, f"q {one} r s t"), (4, f"q {other} r s t")]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _joined(rows) and all(r["class_id"] == r["doc_id"] for r in got)


def test_long_texts_are_joined(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-300])), (3, " ".join(long[:1000])), (4, "x " * 50_000)]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _joined(rows)


def test_one_of_each_group_stays(spark):
    base = [f"b{i}" for i in range(60)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(5)]
    rows = [(5, near[0]), (5, "another text of the same id"), (3, near[1]), (None, near[2]), (None, "nothing like it"), (None, "nothing like it"), (9, None), (8, ""), (7, "u v"), (7, "u v"), (6, "u v")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(5, "another text of the same id"), (3, near[1]), (None, "nothing like it"), (8, ""), (6, "u v")], key=str)
    assert J.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_recall_of_every_fiftieth_document(spark, folder):
    from lodestrata.runtime import table

    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    got = {r["doc_id"]: r["n_links"] for r in J.join(table(spark, folder, "documents")).collect()}
    for i, s in sets.items():
        if i % 50 == 0:
            near = sum(1 for j, other in sets.items() if j != i and (s == other or (s and 5 * len(s & other) >= 4 * len(s | other))))
            assert got[i] == near


def test_join_edges(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 1), (None, "x y z x y z", 2), (3, "a b c d e f", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted((tuple(r)[:4] for r in J.join(docs).collect()), key=str)
    assert got == [(3, 3, 3, 2), (7, 3, 3, 2), (7, 3, 3, 2), (None, None, None, 0)]
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, None]


def test_depth_is_shortened_until_the_recall_is_reached():
    d = J.depth_for(24, 8, 0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9999 and 1 - (1 - 0.8 ** (d + 1)) ** 24 < 0.9999


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (105, 100)]
    got = {r["id"]: r["root"] for r in J.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_columns(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert S.digests(docs).first()[:] == (1, 0, 0, none)
    assert L.digests(docs).first()[:] == (1, 1, 0, none)
