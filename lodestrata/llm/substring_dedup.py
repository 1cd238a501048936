"""Removal of passages of words that occur more than once.

Every window of ``size`` consecutive words of every document gets Rabin-Karp hashes at two
bases, of which 96 bits are kept. The hashes are counted in Spark, and windows that occur
again merge into maximal intervals to remove. Only sorted hashes travel: documents are
dealt into chunks, each chunk sends the hashes that it holds to range partitions of the
hash space, and gets back a bitmap that says which of them other chunks hold as well. A
hash travels once for each chunk, however often it occurs there, so a passage shared by a
third of all rows weighs no more than any other. The chunks' texts are shuffled once and
read twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textops as X
from lodestrata.runtime import extended, free_name, ship

#: UTF-8 bytes of text in a chunk, about two million windows.
CHUNK_BYTES = 12 << 20
_STEP, _REST = np.dtype("<u8"), np.dtype("<u4")
_U = np.uint64


def _pack(key: np.ndarray, rest: np.ndarray) -> bytes:
    """Sorted 64-bit halves as differences of as few bytes as they need, and the other 32 bits."""
    steps = np.diff(key)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    raw = steps.astype(_STEP).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + key[:1].astype(_STEP).tobytes() + rest.astype(_REST).tobytes() + raw.tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = packed[0]
    n = (len(packed) - 9 + width) // (width + 4)
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(packed, np.uint8, 8, 1)
    out[1:, :width] = np.frombuffer(packed, np.uint8, offset=9 + 4 * n).reshape(-1, width)
    return np.cumsum(out.reshape(-1).view(_STEP), dtype=_U), np.frombuffer(packed, _REST, n, 9)


def _ordered(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes stand together, and whether each differs from the one before."""
    order = np.argsort(key, kind="stable")
    k, r = key[order], rest[order]
    if len(k) > 1 and ((k[1:] == k[:-1]) & (r[1:] != r[:-1])).any():
        order = np.lexsort((rest, key))
        k, r = key[order], rest[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return order, fresh


def _window_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts: index of the first word, both parts of the hash; and the words before each text."""
    h, before = X.word_hashes(*X.utf8(texts))
    at = X.fitting(before, size)
    if not len(at):
        return at, np.zeros(0, _U), np.zeros(0, _REST), before
    first, second = X.rolled(h, size, X.BASES[0])[at], X.rolled(h, size, X.BASES[1])[at]
    return at, X.mix(first | second << _U(61)), (second >> _U(3)).astype(_REST), before


def _cuts(key: np.ndarray, bits: int) -> np.ndarray:
    """Where in sorted keys each of 2^bits ranges of the hash space begins, and the end."""
    if not bits:
        return np.array([0, len(key)])
    return np.append(np.searchsorted(key, np.arange(1 << bits, dtype=_U) << _U(64 - bits)), len(key))


def remove_repeats(docs: DataFrame, size: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``removed`` (array of start and end words) and ``kept_text``.

    Words are runs of characters other than space and tab to carriage return. A word is
    removed if a window of ``size`` words of its document covers it whose word sequence
    also starts anywhere else, in this document too. Windows are judged on the input.
    Intervals are maximal: they neither touch nor overlap. ``kept_text`` has the other
    words joined by one space.

    Null and empty texts have no words. Texts shorter than ``size`` words lose none.
    Repeated rows count as different documents, so that both lose what they share; ties
    and null keys don't matter, as keys only deal rows into chunks. Rows equal in key and
    text are dealt by their input partition as well, and a chunk hashes equal texts once. A
    text longer than ``CHUNK_BYTES`` makes a chunk as large as itself. Other columns pass
    through; columns named like the new ones are replaced. An empty table gives an empty
    one. Two different windows count as equal with a chance of about 2^-96.
    """
    spark = docs.sparkSession
    ship(spark)
    new = ("n_words", "removed", "kept_text")
    docs = docs.drop(*new)
    chunk = free_name(docs, "chunk_")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    bits = (chunks - 1).bit_length()
    dealt = docs.withColumn(chunk, F.pmod(F.xxhash64(key, text, F.spark_partition_id()), F.lit(chunks)).cast("int"))

    def held(rows: pa.Table) -> pa.Table:
        texts = pc.unique(rows.column(text))
        _, first, rest, _ = _window_hashes(texts, size)
        order, fresh = _ordered(first, rest)
        order = order[fresh]
        first, rest = first[order], rest[order]
        cuts = _cuts(first, bits)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        return pa.table({
            "chunk_": pa.array([rows.column(chunk)[0].as_py()] * len(full), pa.int32()),
            "bucket_": pa.array(full, pa.int32()),
            "hashes_": pa.array([_pack(first[cuts[i] : cuts[i + 1]], rest[cuts[i] : cuts[i + 1]]) for i in full], pa.binary()),
        })

    def counted(rows: pa.Table) -> pa.Table:
        lists = [_unpack(x.as_py()) for x in rows.column("hashes_")]
        cuts = np.cumsum([0, *(len(x) for x, _ in lists)])
        first, rest = (np.concatenate(x) for x in zip(*lists))
        del lists
        order, fresh = _ordered(first, rest)
        alone = fresh & np.append(fresh[1:], True)
        again = np.empty(len(first), bool)
        again[order] = ~alone
        bitmaps = [np.packbits(again[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"chunk_": rows.column("chunk_"), "bucket_": rows.column("bucket_"), "again_": pa.array(bitmaps, pa.binary())})

    sent = dealt.groupBy(chunk).applyInArrow(held, "chunk_ int, bucket_ int, hashes_ binary")
    answers = sent.groupBy("bucket_").applyInArrow(counted, "chunk_ int, bucket_ int, again_ binary")
    schema = extended(docs.schema, "n_words long, removed array<struct<start:int,end:int>>, kept_text string")

    def apply(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        coded = rows.column(text).combine_chunks()
        coded = (coded if isinstance(coded, pa.Array) else pa.concat_arrays(coded.chunks)).dictionary_encode("encode")
        texts, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        at, first, rest, before = _window_hashes(texts, size)
        order, fresh = _ordered(first, rest)
        starts = np.flatnonzero(fresh)
        again = np.diff(np.append(starts, len(order))) > 1
        cuts = _cuts(first[order[starts]], bits)
        for bucket, packed in zip(bitmaps.column("bucket_").to_pylist(), bitmaps.column("again_").to_pylist()):
            a, b = cuts[bucket], cuts[bucket + 1]
            again[a:b] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        hit = at[order[again[np.cumsum(fresh) - 1]]] if len(at) else at
        # all windows of a text that this chunk holds more than once occur again
        copied = np.bincount(which, minlength=len(texts)) > 1
        if len(at):
            hit = np.concatenate([hit, at[copied[X.row_of(at, before)]]])
        n = int(before[-1])
        marks = np.bincount(hit, minlength=n + 1) - np.bincount(np.minimum(hit + size, n), minlength=n + 1)
        told = _told(texts, np.cumsum(marks)[:n] > 0, before).take(pa.array(which))
        out = rows.drop_columns([chunk])
        for name in told.column_names:
            out = out.append_column(name, told.column(name))
        return out

    return dealt.groupBy(chunk).cogroup(answers.groupBy("chunk_")).applyInArrow(apply, schema)


def _told(texts: pa.Array, gone: np.ndarray, before: np.ndarray) -> pa.Table:
    """n_words, removed and kept_text of each text."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    # an interval that reaches over rows is cut at their edges
    inner = before[(before > 0) & (before < len(gone))]
    inner = inner[gone[inner - 1] & gone[inner]] if len(inner) else inner
    low, high = np.sort(np.concatenate([edge[::2], inner])), np.sort(np.concatenate([edge[1::2], inner]))
    keep = low < high
    low, high = low[keep], high[keep]
    at = np.searchsorted(low, before)
    owner = X.row_of(low, before)
    spans = pa.ListArray.from_arrays(
        pa.array(at, pa.int32()),
        pa.StructArray.from_arrays([pa.array(low - before[owner], pa.int32()), pa.array(high - before[owner], pa.int32())], ["start", "end"]),
    )
    kept = []
    for i, value in enumerate(texts):
        found = (value.as_py() or "").encode().split()
        if at[i] < at[i + 1]:
            out, last = [], 0
            for a, b in zip((low[at[i] : at[i + 1]] - before[i]).tolist(), (high[at[i] : at[i + 1]] - before[i]).tolist()):
                out += found[last:a]
                last = b
            found = out + found[last:]
        kept.append(b" ".join(found))
    return pa.table({"n_words": pa.array(np.diff(before), pa.int64()), "removed": spans, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document: its words, how many of them go, and a digest of the rest."""
    out = remove_repeats(docs.select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same rows by DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, k, sha256(array_to_string(ws[k:k + 34], ' ')) AS m FROM win),
again AS (SELECT doc_id, k FROM h QUALIFY count(*) OVER (PARTITION BY m) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
told AS (
  SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN told USING (doc_id)
"""
