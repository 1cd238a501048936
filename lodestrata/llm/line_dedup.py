"""Removal of lines that occur in other documents as well.

The keys of lines are hashed, and the hashes are dealt into equal ranges of the hash
space, with each range sorted by hash, document and position. A task streams over its
range and decides each line as it passes; what goes back is not text but a compressed
bitmap for each document that loses lines, which is then joined to the documents.

Each map task aggregates before anything is shuffled: of a key that it finds in enough
documents it decides all lines itself and sends a single mark, and of any other key it
sends fewer rows than ``min_docs``. So a line that stands in a third of all documents costs
a few rows for each task, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import extended, free_name, ship

_ROWS = pa.schema([("range_", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("mark", pa.int32()), ("doc", pa.int64()), ("own", pa.int64()), ("at", pa.binary())])
_DDL = "range_ int, h1 long, h2 long, mark int, doc long, own long, at binary"


def line_key(line: bytes) -> bytes:
    """A line without white space at both ends, with A-Z in lower case."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def keep_bitmaps(docs: DataFrame, min_docs: int | None = None, min_chars: int = 1, ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, own, bitmap) for the documents that lose lines.

    ``docs`` has doc_id and text. ``min_docs`` None: of each key the first line stays, in
    the order of document and position. Otherwise keys found in at least so many documents
    lose all their lines. Keys shorter than ``min_chars`` code points are left alone.
    ``own`` is the hash of the text; with doc_id it names a document, so that rows with the
    same id and text are one document, and rows with the same id and other texts are not.
    ``bitmap`` is a zlib-compressed bit for each dropped line, up to the last one.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("own"), "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _of_batch(batch, parts, min_docs, min_chars)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decided(batches, min_docs)

    order = ["h1", "h2", "mark", F.col("doc").asc_nulls_first(), "own", "at"]
    sent = named.mapInArrow(lines, _DDL)
    ranged = sent.repartitionById(parts, "range_").sortWithinPartitions(*order)
    gone = ranged.mapInArrow(stream, "doc long, own long, at binary")
    grouped = gone.groupBy("doc", "own").agg(F.collect_list("at").alias("at"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column("at").to_pylist():
                at = np.concatenate([np.frombuffer(x, "<i4") for x in pieces])
                bits = np.zeros(int(at.max()) + 1, bool)
                bits[at] = True
                out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("own"), pa.array(out, pa.binary())], ["doc_id", "own", "bitmap"])

    return grouped.mapInArrow(bitmaps, "doc_id long, own long, bitmap binary")


def _of_batch(batch: pa.RecordBatch, parts: int, min_docs: int | None, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows to send: marks (0), undecided lines (1), and lines decided here (2)."""
    ids, owns = batch.column("doc").to_pylist(), batch.column("own").to_pylist()
    where: dict[bytes, list[tuple[int, int]]] = {}
    repeated: set[tuple[int | None, int]] = set()
    seen: set[tuple[int | None, int]] = set()
    for row, value in enumerate(batch.column("text").to_pylist()):
        name = (ids[row], owns[row])
        if name in seen:  # the same row again: one document
            repeated.add(name)
            continue
        seen.add(name)
        for at, line in enumerate((value or "").encode().split(b"\n")):
            if _long_enough(key := line_key(line), min_chars):
                where.setdefault(key, []).append((row, at))
    local: dict[int, list[int]] = {}
    out: tuple[list, ...] = tuple([] for _ in _ROWS)

    def send(h: int, mark: int, row: int | None, at: list[int]) -> None:
        h1, h2 = h >> 64, h & (1 << 64) - 1
        part = h1 * parts >> 64
        doc, own = (None, 0) if row is None else (ids[row], owns[row])
        for column, v in zip(out, (part, h1 - (1 << 63), h2 - (1 << 63), mark, doc, own, np.array(at, "<i4").tobytes())):
            column.append(v)

    for key, places in where.items():
        h = xxhash.xxh3_128_intdigest(key)
        if min_docs is None:
            first = min(places, key=lambda p: (ids[p[0]] is not None, ids[p[0]] or 0, owns[p[0]], p[1]))
            send(h, 1, first[0], [first[1]])
            for row, at in places:
                if (row, at) != first:
                    local.setdefault(row, []).append(at)
            continue
        by_row: dict[int, list[int]] = {}
        for row, at in places:
            by_row.setdefault(row, []).append(at)
        if len(by_row) >= min_docs:
            send(h, 0, None, [])
            for row, ats in by_row.items():
                local.setdefault(row, []).extend(ats)
        else:
            for row, ats in by_row.items():
                send(h, 1, row, ats)
    for row, ats in local.items():  # decided lines only pass through, dealt by document
        send(xxhash.xxh3_128_intdigest(f"{ids[row]} {owns[row]}".encode()), 2, row, ats)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROWS)], schema=_ROWS)


def _decided(batches: Iterator[pa.RecordBatch], min_docs: int | None) -> Iterator[pa.RecordBatch]:
    """Streams over rows sorted by key, document and position, and passes on the lines that go.

    Of the open key only the lines of fewer than ``min_docs`` documents are held back.
    """
    key, drop, names, held = None, False, set(), []
    for batch in batches:
        docs, owns, ats = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "mark", "doc", "own", "at")]
        for h1, h2, mark, doc, own, at in zip(*columns):
            if mark == 2:
                docs.append(doc), owns.append(own), ats.append(at)
                continue
            if (h1, h2) != key:
                key, drop, names, held = (h1, h2), mark == 0, set(), []
                if min_docs is None:
                    # the first in the order stays; the same document may come again from another task
                    drop, first = True, (doc, own, at)
                    continue
            if mark == 0:
                continue
            if min_docs is None and (doc, own, at) == first:
                continue
            if drop:
                docs.append(doc), owns.append(own), ats.append(at)
                continue
            names.add((doc, own))
            held.append((doc, own, at))
            if len(names) >= min_docs:
                drop = True
                for d, o, a in held:
                    docs.append(d), owns.append(o), ats.append(a)
                names, held = set(), []
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(owns, pa.int64()), pa.array(ats, pa.binary())], ["doc", "own", "at"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept_text`` to the documents."""
    bitmap = free_name(docs, "bitmap_")
    found = bitmaps.select(F.col("doc_id").alias("doc_"), F.col("own").alias("own_"), F.col("bitmap").alias(bitmap))
    same = (F.xxhash64(docs["text"]) == found["own_"]) & docs["doc_id"].cast("long").eqNullSafe(found["doc_"])
    joined = docs.join(found, same, "left").select(*(docs[c] for c in docs.columns), found[bitmap])
    names = [c for c in docs.columns]
    schema = extended(docs.schema, "n_lines long, n_dropped long, kept_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lost, kept = [], [], []
            for value, packed in zip(batch.column("text").to_pylist(), batch.column(bitmap).to_pylist()):
                value = value or ""
                n, k = value.count("\n") + 1, 0
                if packed is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=None)[:n].tolist()
                    bits += [0] * (n - len(bits))
                    k = sum(bits)
                    value = "\n".join(x for x, gone in zip(value.split("\n"), bits) if not gone)
                counts.append(n), lost.append(k), kept.append(value)
            made = [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int | None = None, min_chars: int = 1) -> DataFrame:
    """Adds ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text`` to the documents.

    Lines are the parts of a text between line feeds; a null or empty text is one empty
    line. Which lines go is described at ``keep_bitmaps``. A document that loses all lines
    has an empty ``kept_text``. Rows are neither lost nor multiplied; other columns pass
    through, and columns named like the new ones are replaced. An empty table gives an
    empty one.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars))


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document: its lines, how many go, and a digest of the rest."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same rows by DuckDB.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key)
GROUP BY doc_id
"""
