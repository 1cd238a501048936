"""Each stage of the pipeline keeps what brute force keeps, on its own input."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from llm_brute import groups, lines_left
from lodestrata.llm.queries import TOKENIZER
from lodestrata.runtime import settle, table
from test_decontam import plain_overlaps


@pytest.fixture(scope="module")
def steps(spark, sf):
    out = [table(spark, sf, "documents")]
    for name, stage in C.STAGES:
        out.append(settle(stage(spark, out[-1], sf), name))
    return [{r["doc_id"]: r for r in x.collect()} for x in out]


def test_names_and_columns(spark, sf, steps):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe"]
    docs = table(spark, sf, "documents").columns
    for step in steps[:-1]:
        assert list(next(iter(step.values())).asDict()) == docs
    assert all(len(a) >= len(b) for a, b in zip(steps, steps[1:]))


def test_lines(steps):
    before, after = steps[1], steps[2]
    want = lines_left({i: r["text"] for i, r in before.items()}, C.MIN_DOCS)
    assert {i: r["text"] for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near_copies(steps):
    before, after = steps[2], steps[3]
    assert set(after) == set(groups({i: r["text"] for i, r in before.items()}).values())


def test_benchmark(spark, sf, steps):
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    found = plain_overlaps([(i, r["text"]) for i, r in steps[3].items()], items)
    lost = {i for i, _, n, matched, _ in found if matched and matched >= 0.6 * n}
    assert set(steps[4]) == set(steps[3]) - lost and lost


def test_codes(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    assert set(steps[5]) == set(steps[4])
    for i, r in steps[5].items():
        ids = tokenizer.encode(steps[4][i]["text"], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_unusual_rows(spark, sf, name, stage):
    text = "One line of this text\nand a second line with some more words in it"
    rows = [(1, text, "en", "web", len(text)), (1, text, "en", "web", len(text)), (None, None, None, None, None), (2, "", None, "web", 0), (None, text + " !", None, None, 3), (3, "word " * 30_000, "en", None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, own_ int, lost_ int, bitmap_ int")
    out = stage(spark, docs, sf)
    kept = out.collect()
    assert stage(spark, docs.limit(0), sf).count() == 0
    if name != "bpe":
        assert out.columns == docs.columns
    want = {"ngram_join": 3}.get(name, 6)  # one of the rows that are equal or alike, and one of those without words
    assert len(kept) == want


def test_clean_documents_stay(spark, sf, steps):
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    gone = set(steps[0]) - set(steps[1])
    assert sum(toxic.get(i) == 0 for i in gone) <= 2
