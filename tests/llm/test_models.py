"""Toxicity, quality, licences and decontamination."""

from __future__ import annotations

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lodestrata.llm import license_scan as Li
from lodestrata.llm import quality as Q
from lodestrata.llm import queries
from lodestrata.llm import toxicity as T
from lodestrata.runtime import table


def _held_out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def _noise(rng, n):
    return [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)]


def test_machine_learns_a_pair(spark):
    # neither word alone tells the classes apart, only both together
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(3000):
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        w = _noise(rng, 30) + ["groupname"] * group + ["insultword"] * insult
        rng.shuffle(w)
        rows.append((i, " ".join(w))), labels.append((i, int(group != insult)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def right(rank):
        machine = T.train(docs, known, rank=rank)
        got = {r["doc_id"]: r["score"] > 0.5 for r in T.score(docs, machine).collect()}
        held = [(got[i], y) for i, y in labels if _held_out(i)]
        return sum(p == bool(y) for p, y in held) / len(held)

    assert right(8) > 0.95 and right(0) < 0.65


def test_scores_by_loops(spark):
    rng = random.Random(1)
    texts = [None, "", "!?", "Ünser wort WORT wörter", "“quoted” «said» it’s", *(" ".join(_noise(rng, 40)) for _ in range(20)), "word " * 5000]
    n = 1 << T.BITS
    some = np.random.default_rng(3)
    machine = T.Machine(0.3, some.normal(size=n).astype(np.float32), some.normal(size=(n, 3)).astype(np.float32))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in T.score(docs, machine).collect()}
    places = {r["doc_id"]: r["terms"] for r in T.features(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert places[i] == sorted(set(places[i]))
        z = 0.3 + sum(float(machine.weights[p]) for p in places[i])
        for a in range(len(places[i])):
            for b in range(a):
                z += float(machine.factors[places[i][a]].astype(float) @ machine.factors[places[i][b]].astype(float))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), abs=1e-5)
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", t or "")}
        beginnings = {(k, w.encode()[:k]) for w in words for k in (4, 6) if len(w.encode()) >= k}
        assert len(places[i]) == len(words) + len(beginnings)


def test_one_label_and_row_for_each_id(spark):
    ids = [i for i in range(40) if not _held_out(i)]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(3)] * 20 + [(None, "x"), (ids[0], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in ids for y in (0, 1)] + [(None, 1), (ids[1], None)], "doc_id long, toxic int")
    first = T.sample(docs, labels, "toxic", 5).collect()
    assert len(first) == 5 and all(r["label_"] == 0 for r in first)
    again = T.sample(docs.repartition(7), labels.repartition(3), "toxic", 5).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(40)] + ["blockhead"] * bad
        rows.append((i, " ".join(w))), labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "blockhead"), (3, rows[3][1])], "doc_id long, text string")
    got = T.scored_documents(docs, spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == 604
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == _held_out(r["doc_id"])
            if r["doc_id"] < 600:
                assert r["predicted"] == int(r["doc_id"] % 5 == 0)


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.score(docs, T.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.first()["score"] == 0.5
    assert T.score(docs.limit(0), T.train(docs, labels)).count() == 0


def test_held_out_labels_are_never_used(spark):
    ids = [i for i in range(400)]
    docs = spark.createDataFrame([(i, f"bad{i % 3}" if i % 2 else "good") for i in ids], "doc_id long, text string")
    honest = [(i, i % 2) for i in ids]
    turned = [(i, 1 - y if _held_out(i) else y) for i, y in honest]
    a, b = (T.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (honest, turned))
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all() and a.bias == b.bias


def _base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = [False] * len(w)
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            cover[k : k + 3] = [True] * 3
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cover))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def test_base_rules(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-3, "a b c a b c " * 20), (-4, "x\n\n x\nx\n　\n　\n é #"), (-5, "q " * 30000), (None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = Q.Model(np.zeros(Q.KINDS << Q.BITS), 0.0, 1.0, 0.0)
    got = {r["doc_id"]: tuple(r)[2:] for r in Q.judge(df, none).collect()}
    for i, t in docs:
        assert got[i][:6] == _base(t)
        assert got[i][7] == (not got[i][5])  # a probability of one half is enough
    assert Q.judge(df.limit(0), none).count() == 0


def test_quality_of_held_out_rows(spark, sf):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    kept = {r["doc_id"]: r["kept"] for r in Q.judged_documents(docs, labels).collect()}
    held = [(kept[r["doc_id"]], r["quality"]) for r in labels.collect() if _held_out(r["doc_id"])]
    assert sum(k == bool(q) for k, q in held) >= 0.85 * len(held)


def test_block_and_row_scores_agree(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "cde", "é", "f!"], k=rng.randint(0, 30))) for _ in range(30)]
    model = Q.Model(np.random.default_rng(0).normal(size=Q.KINDS << Q.BITS), 0.3, 1.0, 0.0)
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = Q._model_output(np.frombuffer(raw, np.uint8), offsets, model)
    rows = Q.frequencies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"]).collect()
    for r in rows:
        z = 0.3 + sum(model.weights[p] * s**0.5 for p, s in zip(r["places"], r["shares"]))
        assert whole[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_licences(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software."), ("a/b/x.py", "print(1)"), ("a/b/y.py", "# SPDX-License-Identifier: Apache-2.0\ncode"),
        ("c/z.py", "no"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/e.txt", None), (None, ""), ("a/b/x.py", "print(1)"), ("top.txt", "All rights reserved."),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in Li.scan(files).collect()}
    assert got == {
        "a/LICENSE": ("MIT", None), "a/b/x.py": ("GPL-3.0", "a/b"), "a/b/y.py": ("Apache-2.0", None), "c/z.py": ("proprietary", ""), "a/b/COPYING": ("GPL-3.0", None),
        "a/b/c/d/e.txt": ("GPL-3.0", "a/b"), "": ("proprietary", ""), "top.txt": ("proprietary", None),
    }
    assert Li.scan(files.limit(0)).count() == 0


_MIT = """MIT License

Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
_APACHE_HEADER = """#!/usr/bin/env python
# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
import os
"""
_GPL_HEADER = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Affero General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */
""" + "int x;\n" * 99


def test_whole_licence_texts_and_header_blocks(spark):
    known = dict(Li.texts()[::-1])
    grant = "\n".join(_MIT.split("\n")[4:10])
    bsd = "Copyright (c) 2001, Example Corp.\n" + known["BSD-3-Clause"].replace("copyright holder", "Example Corp.")
    rows = [
        ("m/LICENSE", _MIT), ("m/a/b.py", "x = 1"), ("b/COPYING", bsd), ("b/c.c", "int x;"), ("p/LICENSE.txt", known["Apache-2.0"]), ("p/q/r.py", "y = 2"),
        ("h/apache.py", _APACHE_HEADER), ("h/agpl.c", _GPL_HEADER), ("h/mit.py", "print(1)\n\n" + grant + "\n\nprint(2)\n" * 99), ("n/none.py", "# a comment\n# on two lines\nz = 3"),
        *((f"l{i}/LICENSE", known[x]) for i, x in enumerate(("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "ISC", "Unlicense", "BSD-2-Clause"))),
    ]
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in Li.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["m/LICENSE"] == ("MIT", None) and got["m/a/b.py"] == ("MIT", "m")
    assert got["b/COPYING"] == ("BSD-3-Clause", None) and got["b/c.c"] == ("BSD-3-Clause", "b")
    assert got["p/LICENSE.txt"] == ("Apache-2.0", None) and got["p/q/r.py"] == ("Apache-2.0", "p")
    assert got["h/apache.py"] == ("Apache-2.0", None) and got["h/agpl.c"] == ("AGPL-3.0", None)
    assert got["h/mit.py"] == ("MIT", None) and got["n/none.py"] == (None, None)
    for i, x in enumerate(("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "ISC", "Unlicense", "BSD-2-Clause")):
        assert got[f"l{i}/LICENSE"] == (x, None)
    # a document that is a licence text by its words, whatever it is called
    assert Li.units(spark.createDataFrame([("m/notes", _MIT)], "path string, text string"), 0.5).where("is_file").count() == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
