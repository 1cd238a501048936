"""Decontamination against a plain version and by planted questions."""

from __future__ import annotations

import collections
import random
import re
import time

import pytest

from lodestrata.llm import decontam as D
from lodestrata.llm import queries
from lodestrata.runtime import table

ITEM = "If Anna buys 12 apples for 3.50 dollars each at the market, how many dollars does she pay in total today?"
_RUN = re.compile(rb"(?:[0-9A-Za-z\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+")


def _tokens(text):
    """(word, kind, capitalised) of each token, by loops over one text."""
    raw, out, last, number = (text or "").encode(), [], 0, False
    for m in _RUN.finditer(raw):
        word = m.group()
        folded = re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda x: bytes([0xC3, x.group()[1] + 32]), word).lower()
        opens = not out or any(c in b".!?:\n" for c in raw[last : m.start()])
        kind = "number" if word[:1].isdigit() else "unit" if number and not opens and folded.decode("latin-1") in D.UNITS else ""
        large = 65 <= word[0] <= 90 or (word[0] == 0xC3 and len(word) > 1 and 0x80 <= word[1] <= 0x9E)
        capital = not kind and large and len(word) > 1 and (97 <= word[1] <= 122 or word[1] >= 128)
        out.append((folded, kind, capital))
        last, number = m.end(), kind == "number"
    return out


def _keys(tokens, small, large, own, sizes):
    """place -> keys of the windows there, with the fillers of their placeholders."""
    out = collections.defaultdict(dict)
    n = len(tokens)
    readings = [
        [not k and ((c and w not in small) or (w in large and w not in small)) for w, k, c in tokens],
        [c for _, _, c in tokens],
        [False] * n,
    ]
    for names in readings:
        forms = [(k or "name" if k or x else w) for (w, k, _), x in zip(tokens, names)]
        fillers = [w if k or x else None for (w, k, _), x in zip(tokens, names)]
        for a in range(n - D.SIZE + 1):
            f = fillers[a : a + D.SIZE]
            literal = sum(x is None for x in f)
            pattern = tuple(f.index(x) if x is not None else -1 for x in f)
            words = tuple(w for w, _, _ in tokens[a : a + D.SIZE])
            key = ("t", tuple(forms[a : a + D.SIZE]), pattern) if literal >= D.FLOOR else ("w", words, pattern)
            out[a].setdefault(key, f)
    for k in sizes:
        whole = tuple(w for w, _, _ in tokens)
        for a in range(n - k + 1):
            if n == k or not (own or k < D.LEAST):
                out[a][("s", k, whole[a : a + k])] = [None] * D.SIZE
    return out


def plain_overlaps(docs, items):
    """(doc_id, item_id, item_windows, matched, verbatim), all by loops."""
    spelt = [_tokens(t) for _, t in items]
    small = {w for x in spelt for w, k, c in x if not k and not c}
    large = {w for x in spelt for w, k, c in x if c}
    sizes = sorted({len(x) for x in spelt if 0 < len(x) < D.SIZE})
    theirs = [_keys(x, small, large, True, sizes) for x in spelt]
    out = []
    for i, text in docs:
        mine = _keys(_tokens(text), small, large, False, sizes)
        for (j, _), own, tokens in zip(items, theirs, spelt):
            places = collections.defaultdict(list)
            for b in sorted(own):
                for key in own[b]:
                    places[key].append(b)
            votes, began, pairs, ahead = collections.Counter(), {}, [], None
            for a in sorted(mine):
                here = [(a - ahead if ahead is not None and a - ahead in places[key] else places[key][0], key) for key in mine[a] if key in places]
                for b, key in here:
                    pairs.append((b, own[b][key], mine[a][key]))
                    for p, (x, y) in enumerate(zip(own[b][key], mine[a][key])):
                        if x is not None:
                            votes[x, y] += 1
                            began[x, y] = min(began.get((x, y), (a + p, b + p)), (a + p, b + p))
                if here:
                    ahead = a - min(b for b, _ in here)
            if not pairs:
                continue
            stands, taken = {}, set()
            for x, y in sorted(votes, key=lambda v: (-votes[v], began[v])):
                if x not in stands and y not in taken:
                    stands[x] = y
                    taken.add(y)
            good = [(b, x == y) for b, x, y in pairs if all(stands.get(p) == q for p, q in zip(x, y) if p is not None)]
            out.append((i, j, max(1, len(tokens) - D.SIZE + 1), len({b for b, _ in good}), len({b for b, s in good if s})))
    return sorted(out, key=str)


def _got(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, D.overlaps(d, b).collect()), key=str)


def test_all_pairs_by_loops(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(["Tom", "Ann", "has", "buys", "and", "the", "3", "7.5", "km", "apples", "École", "in.", "How"], k=rng.randint(1, 40)))) for i in range(30)]
    docs = []
    for i in range(150):
        t = rng.choice(items)[1]
        t = t.replace("Tom", rng.choice(["Tom", "Bob"])).replace("3", rng.choice(["3", "9"])).replace("Ann", rng.choice(["Ann", "ann", "Eve"]))
        docs.append((i, f"{rng.choice(['', 'Some words. ', 'x'])}{rng.choice([t, t.lower(), t.upper(), t])} end"))
    docs += [(900, None), (901, ""), (None, items[0][1]), (5, docs[5][1]), (902, "Yes"), (903, "the word yes is here"), (904, items[3][1] * 30)]
    items += [(100, None), (101, ""), (102, "Yes"), (103, "one of five words"), (3, items[3][1]), (None, items[4][1])]
    got, want = _got(spark, docs, items), plain_overlaps(docs, items)
    assert got == want
    assert len(got) > 100


def test_query_by_loops(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = [r for r in plain_overlaps(docs, items) if r[3] and r[3] >= 0.6 * r[2]]
    assert sorted(map(tuple, queries.op8_decontamination(spark, sf).collect()), key=str) == want


@pytest.mark.parametrize("text, hit", [
    (f"Intro text. {ITEM} More text.", True),
    (f"intro {ITEM.upper()} end", True),
    (ITEM.replace("12", "19").replace("3.50", "2"), True),
    ("If Bella" + ITEM[7:], True),
    ("Nothing of it is in this text, although it speaks of 12 apples for 3.50 dollars.", False),
    ("", False), (None, False),
])
def test_reparameterised_questions(spark, text, hit):
    assert bool([r for r in _got(spark, [(5, text)], [(1, ITEM), (2, "")]) if r[3] >= 0.6 * r[2]]) == hit


def test_short_items_are_not_in_every_text(spark):
    items = [(1, "42"), (2, "Yes"), (3, "four words stand here")]
    docs = [(1, "42 or 17 things"), (2, "yes it is"), (3, "yes."), (4, "here four words stand here too"), (5, "four other words stand here")]
    assert [r[:2] for r in _got(spark, docs, items)] == [(3, 2), (4, 3)]


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"
    docs = [item, item.replace("Tom", "Ann"), f"Yesterday {item}", item.lower(), item.upper(), item.replace(". How", ", how").replace("Tom", "Ann")]
    # one name of the item can't be two names of the document; only the first window has two
    docs.append("Ann has 5 apples. Bob buys 3 more. How many apples does Bob have?")
    assert [r[2:] for r in _got(spark, list(enumerate(docs)), [(1, item)])] == [(7, 7, 7), (7, 7, 0), (7, 7, 7), (7, 7, 7), (7, 7, 7), (7, 7, 0), (7, 6, 0)]


def test_one_binding_for_document_and_item(spark):
    item = "Alice picks 3 red apples from the old tree today. Later on Alice sells 3 red apples at the small market there."
    turned = item.replace("Alice picks 3", "Bella picks 9").replace("Alice sells 3", "Carla sells 8")
    (row,) = _got(spark, [(1, turned)], [(1, item)])
    by_hand = plain_overlaps([(1, turned)], [(1, item)])[0]
    assert row == by_hand and row[3] < row[2]
    (whole,) = _got(spark, [(1, item.replace("Alice", "Bella").replace("3", "9"))], [(1, item)])
    assert whole[3] == whole[2]


def test_tables_of_figures_take_linear_time(spark):
    items = [(1, " ".join(map(str, range(2000)))), (2, " ".join(f"Ann{i} has {i} apples and buys the" for i in range(300)))]
    docs = [(1, " ".join(str(i * 7 % 100003) for i in range(50000))), (2, " ".join(f"Bo{i} has {i * 3} apples and buys the" for i in range(7000)))]
    began = time.perf_counter()
    got = _got(spark, docs, items)
    assert time.perf_counter() - began < 60
    assert [r[:2] for r in got] == [(2, 2)]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    import numpy as np

    raw = ("Tom has 5 km and École. 7 m 8\nkm " * 50).encode()
    offsets = np.array([0, 100, 101, len(raw)])
    whole = D.tokens(np.frombuffer(raw, np.uint8), offsets)
    for size in (1, 7, 64):
        monkeypatch.setattr(D, "_PIECE", size)
        for x, y in zip(D.tokens(np.frombuffer(raw, np.uint8), offsets), whole):
            assert (x == y).all()


def test_contaminated_documents(spark):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "a short item of six words", 0)], "item_id long, text string, matched int")
    docs = spark.createDataFrame([(1, f"x. {ITEM}"), (2, "clean"), (3, None), (4, "see a short item of six words b"), (1, f"x. {ITEM}"), (None, ITEM)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (4, 3), (None, 1)], key=str)
    assert sorted((r["doc_id"] for r in D.decontaminate(docs, bench).collect())) == [2, 3]
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == 6
    named = docs.selectExpr("doc_id", "text", "1 AS key_x", "2 AS item_id")
    assert D.decontaminate(named, bench).columns == ["doc_id", "text", "key_x", "item_id"]


@pytest.mark.parametrize("share", [0.05, 0.3, 0.6, 1.0])
def test_rarest_windows_find_all_pairs_above_a_share(spark, share):
    rng = random.Random(11)
    stock = "please read the whole text and then write down the answer in full"
    items = [(i, f"{stock} " * rng.randint(0, 2) + " ".join(rng.choices(["Tom", "Ann", "has", "and", "the", "3", "km", "apples", "in", "how", "many"], k=rng.randint(1, 30)))) for i in range(40)]
    docs = [(i, f"{stock} " * rng.randint(0, 2) + rng.choice(items)[1][rng.randint(0, 40) :]) for i in range(200)] + [(200, None), (None, items[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.contaminated(d, b, share).collect()), key=str)
    assert got == [r for r in plain_overlaps(docs, items) if r[3] and r[3] >= share * r[2]]


def test_a_stock_phrase_makes_no_pairs(spark):
    stock = "please read the whole text and then write down the answer in full"
    items = [(i, f"{stock} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(300)]
    docs = [(i, f"{stock} " + " ".join(f"v{i}x{j}" for j in range(20))) for i in range(300)] + [(1000, items[7][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [tuple(r)[:2] for r in D.overlaps(d, b, 0.6).collect()] == [(1000, 7)]


def test_blocks_of_a_benchmark_with_very_many_words(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)]
    docs = [(i, "intro " + t) for i, t in items] + [(1000, "w1x2 w3x4 " * 10)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "MOST_WORDS", 500)
    assert sorted(tuple(r)[:2] for r in D.contaminated(d, b).collect()) == [(i, i) for i in range(60)]
