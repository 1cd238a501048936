"""WARC archives and token shards: round trips and damage."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io

import numpy as np
import pyarrow.fs as pafs
import pytest

from lodestrata.llm import queries
from lodestrata.llm import token_output as T
from lodestrata.llm import warc as W
from lodestrata.llm.bpe import codec
from lodestrata.runtime import scratch, table


def test_pages_come_back(spark):
    rows = [(1, "http://a/1", "<p>same</p>", 0), (2, "http://a/2", "<p>same</p>", 0), (9, "http://a/9", "<p>same</p>", 0), (3, None, None, 0), (4, "x", "", 0), (5, "u\r\nv", "é\r\n\r\nWARC/1.1\r\n", 0), (6, "y", "z" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = {r["page_id"]: tuple(r)[1:] for r in W.round_trip(pages).collect()}
    payload = {i: (h or "").encode() for i, _, h, _ in rows}
    twin = {1: 9, 2: 9, 3: 4}
    for i, p in payload.items():
        sha = base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert got[i] == (len(p), sha, "revisit" if i in twin else "response", twin.get(i))


def test_small_payloads_and_repeats(spark):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc"), (4, "", "abc"), (None, "", "abc")], "page_id long, url string, html string")
    got = sorted((tuple(r)[0::3] for r in W.round_trip(pages, min_bytes=3).collect()), key=str)
    assert got == sorted([(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response"), (None, "response")], key=str)
    assert W.round_trip(pages.limit(0)).count() == 0


def test_one_page_id_with_two_payloads(spark):
    pages = spark.createDataFrame([(5, "", "A"), (5, "", "B"), (9, "", "A")], "page_id long, url string, html string")
    back = W.read(W.write(pages, scratch(spark, "warc"))).collect()
    assert sorted((r["record_id"], r["record_type"], bytes(r["payload"] or b""), r["refers_to"]) for r in back) == [
        ("<urn:page:5>", "response", b"B", None), ("<urn:page:5>", "revisit", b"", "<urn:page:9>"), ("<urn:page:9>", "response", b"A", None),
    ]


def test_archives_are_split_and_gzip(spark):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 1000) AS html")
    made = W.write(pages.coalesce(1), scratch(spark, "warc"), archive_bytes=500).collect()
    assert len(made) > 5 and sum(r["records"] for r in made) == 50
    fs, path = pafs.FileSystem.from_uri(made[0]["path"])
    with fs.open_input_stream(path, compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def _archive() -> bytes:
    return b"".join(W.member(W._record(i, "u", f"body {i}" * 50, None)) for i in range(3))


def test_reader_streams(monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 7)
    assert [r.payload() for r in W.read_records(io.BytesIO(_archive()))] == [(f"body {i}" * 50).encode() for i in range(3)]
    assert list(W.read_records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("damage", ["short", "digest", "length", "header", "bits"])
def test_damage_is_found(damage):
    raw = _archive()
    if damage == "short":
        raw = raw[:-20]
    elif damage == "bits":
        raw = raw[:-30] + b"\xff" * 10 + raw[-20:]
    else:
        plain = gzip.decompress(W.member(W._record(1, "u", "hello", None)))
        change = {"digest": (b"hello", b"hellx"), "length": (b"Content-Length: 83", b"Content-Length: 82"), "header": (b"WARC/1.1", b"XARC/1.1")}[damage]
        assert change[0] in plain
        raw = gzip.compress(plain.replace(*change))
    with pytest.raises(W.DamagedArchive):
        list(W.read_records(io.BytesIO(raw)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    image = T.feistel(np.arange(n), n, 7)
    assert sorted(image.tolist()) == list(range(n))
    assert (image == T.feistel(np.arange(n), n, 7)).all()
    if n > 100:
        assert (image != T.feistel(np.arange(n), n, 8)).any()


@pytest.mark.parametrize("tokenizer, length", [("bytes", 64), ("byte_bpe_50k.json", 32)])
def test_shards_hold_every_token(spark, tokenizer, length):
    rows = [(i, f"text {i} é " * (i % 9)) for i in range(40)] + [(50, None), (51, ""), (51, ""), (None, "no id"), (52, "z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    folder = scratch(spark, "tokens")
    manifest = T.materialise(docs, folder, 5, tokenizer, length, shard_sequences=16)
    meta = T.meta_of(spark, folder)
    inverse = {int(s): i for i, s in enumerate(T.feistel(np.arange(meta["sequences"]), meta["sequences"], 5))}
    records = {}
    for shard in manifest.collect():
        held = list(T.read_shard(shard["path"], shard["first_slot"], shard["sequences"], meta))
        assert [h[0] for h in held] == list(range(shard["first_slot"], shard["first_slot"] + shard["sequences"]))
        records.update({inverse[slot]: (begun, ids) for slot, begun, _, _, ids in held})
        # a reader goes on where it stopped
        later = list(T.read_shard(shard["path"], shard["first_slot"], shard["sequences"], meta, shard["first_slot"] + 3))
        assert [x[0] for x in later] == [x[0] for x in held[3:]]
    assert sorted(records) == list(range(meta["sequences"]))
    flat = np.concatenate([records[i][1] for i in sorted(records)])
    flat = flat[flat != meta["pad"]]
    parts = np.split(flat, np.flatnonzero(flat == meta["end"]) + 1)[:-1]
    decode = (lambda a: a.tobytes().decode()) if tokenizer == "bytes" else (lambda a: codec(tokenizer).decode(a.tolist()))
    assert collections.Counter(decode(p[:-1]) for p in parts) == collections.Counter(t or "" for _, t in rows)
    assert sum(b for b, _ in records.values()) == len(rows)
    read = T.read(manifest, meta).collect()
    assert sorted(r["slot"] for r in read) == list(range(meta["sequences"]))
    assert sum(r["n_tokens"] for r in read) == len(flat)


def test_query_writes_ids_of_the_vocabulary(spark, sf):
    encode = codec(queries.TOKENIZER).encode
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").collect()]
    got = queries.op6_token_output(spark, sf).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(encode(t or "")) + 1 for t in texts)
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and sum(r["n_begun"] for r in got) == len(texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.written_documents(docs).count() == 0


def test_long_records_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = [b"", b"x", b"a" * 3_000_000, rng.bytes(700_000), b"\r\n\r\n" * 50]
    records = [W.Record({"WARC-Type": "resource", "WARC-Block-Digest": f"sha1:{W.digest(b)}"}, b) for b in blocks]
    raw = b"".join(map(W.member, records))
    for piece, chunk in ((1 << 20, 1 << 18), (64, 1 << 18), (1000, 7)):
        monkeypatch.setattr(W, "PIECE_BYTES", piece)
        monkeypatch.setattr(W, "READ_BYTES", chunk)
        assert [r.block for r in W.read_records(io.BytesIO(raw))] == blocks
    for bad in (b"Content-Length: 3000001", b"Content-Length: 2999999", b"Content-Length: -1", b"Content-Length: x"):
        broken = gzip.compress(gzip.decompress(W.member(records[2])).replace(b"Content-Length: 3000000", bad))
        with pytest.raises(W.DamagedArchive):
            list(W.read_records(io.BytesIO(broken)))
    with pytest.raises(W.DamagedArchive):
        list(W.read_records(io.BytesIO(gzip.compress(b"y" * (W.HEADER_BYTES + 100)))))
    with pytest.raises(W.DamagedArchive):
        list(W.read_records(io.BytesIO(gzip.compress(b""))))


@pytest.mark.parametrize("line,want", [
    ("// This code is licensed under the MIT license", "MIT"), ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0"),
    ("/* SPDX-License-Identifier: Zlib */", "Zlib"), ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
])
def test_old_and_short_forms_of_licences(spark, line, want):
    from lodestrata.llm import license_scan

    files = spark.createDataFrame([("a/b.c", f"{line}\nint main() {{}}\n"), ("a/c.c", "plain text"), ("d/e.py", "# SPDX-License-Identifier: MIT\n")], "path string, text string")
    assert {r["path"]: r["license"] for r in license_scan.scan(files).collect()}["a/b.c"] == want
