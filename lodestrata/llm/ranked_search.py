"""Ranked lexical search by NRA: sorted reads without random access.

The index is dealt by documents. A shard is one row that holds some megabytes of text: the
ids of its documents, its terms, and for each term the documents that hold it, sorted by
falling impact. As a row it is read by one task, and no posting is ever shuffled.

A search reads the lists of an item's terms in each shard from the top, a block of each
list at a time, and keeps an interval for every document: what has been read of it, and
that plus the impact at which each list stands that hasn't shown the document yet. A
document whose upper end is below the k-th lower end can't be a result; those that may
equal it stay. Lists are read until every document left has an interval of one value, so
that membership, ties and scores are settled. A task hands its k-th score on from shard to
shard, and returns k documents for each item, which are merged in two steps.

All arithmetic on scores is in integers; with more documents than 64 bits allow for, the
length factors are computed in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.llm import textops as X
from lodestrata.runtime import marked, settle, ship

#: Bytes of text and documents in a shard, at most; a longer document is a shard by itself.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 14
#: About so many (item, term) rows are broadcast at once; more items are taken in blocks.
BLOCK_TERMS = 1 << 18
#: Postings that the first round reads of each list; every further round reads twice as many.
FIRST_READ = 64
#: Parts that the results of tasks are merged in first.
MERGE_PARTS = 64
#: What a weight or an impact of 1 counts as.
WEIGHT_UNIT, IMPACT_UNIT = 1000, 1_000_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_RAW = "n_docs long, n_tokens long, ids array<long>, lengths binary, terms array<string>, sizes array<int>, docs binary, tfs binary"
_INDEX = "ids array<long>, terms array<string>, sizes array<int>, docs binary, impacts binary"
#: A row of megabytes is a row group by itself, so that writers hold and readers load one at a time, whatever a file holds;
#: without statistics, as a writer holds the least and largest value of every row group until it closes the file.
_SMALL = {"compression": "zstd", "parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.column.statistics.enabled": "false"}


@dataclass(frozen=True)
class Index:
    """The settled shards, the documents with a term, and all their terms with repeats."""

    shards: DataFrame
    n_docs: int
    n_tokens: int


def terms(text: str | Column) -> Column:
    """The terms of a text in order: digits, letters A to Z in lower case, and all beyond ASCII; null has none."""
    plain = F.translate(F.col(text) if isinstance(text, str) else text, _UPPER, _LOWER)
    return F.regexp_extract_all(plain, F.lit(f"({TERM})"), F.lit(1))


def _counted(raw: np.ndarray, offsets: np.ndarray, ids: pa.Array) -> list | None:
    """A shard's documents with a term, and who holds each term how often."""
    inside = _INSIDE[raw]
    starts, ends, before = X.runs(inside, offsets)
    length = np.diff(before)
    held = length > 0
    if not held.any():
        return None
    cuts = np.append(0, np.cumsum(ends - starts))
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(_FOLD[raw[inside]])])
    coded = tokens.dictionary_encode()
    n = int(held.sum())
    key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length[held])
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    code, doc = np.divmod(key[first], n)
    tf = np.diff(np.append(first, len(key)))
    sizes = np.bincount(code, minlength=len(coded.dictionary))
    return [n, len(starts), ids.filter(pa.array(held)), length[held].astype("<i8").tobytes(), coded.dictionary.cast(pa.string()), sizes.astype(np.int32), doc.astype("<i4").tobytes(), tf.astype("<i4").tobytes()]


def _cut(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for low, high in X.blocks(offsets, SHARD_BYTES):
        for at in range(low, high, SHARD_DOCS):
            yield at, min(high, at + SHARD_DOCS)


def _listed(row: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v.to_pylist() if isinstance(v, pa.Array) else v], f.type) for v, f in zip(row, schema)], schema=schema)


_RAW_ARROW = pa.schema([("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())])
_INDEX_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("impacts", pa.binary())])


def length_factors(length: np.ndarray, n_docs: int, n_tokens: int) -> np.ndarray:
    """The factor of each document: 25 + 75 times its length over the mean, rounded down."""
    most = 75 * int(length.max(initial=0)) * n_docs
    wide = length.astype(object) if most >= 1 << 63 else length
    return (25 + 75 * wide * n_docs // n_tokens).astype(np.int64)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Indexes every row.

    Each row is a document, so rows that repeat are found as often as they stand there, and
    a null key is a key. Null and empty texts and texts without terms aren't in the index
    and count for nothing. Texts are read once, as the counts are settled before the
    impacts, which depend on all lengths, are made of them. Of an empty table the index is
    empty. Other columns aren't looked at.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text_"))
            for low, high in _cut(offsets):
                row = _counted(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], batch.column("key_").slice(low, high - low))
                if row:
                    yield _listed(row, _RAW_ARROW)

    counts = settle(docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")).mapInArrow(count, _RAW), "search-counts", _SMALL)
    n_docs, n_tokens = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sizes = batch.column("sizes")[i].values.to_numpy()
                doc, tf = (np.frombuffer(batch.column(c)[i].as_py(), "<i4").astype(np.int64) for c in ("docs", "tfs"))
                m = length_factors(np.frombuffer(batch.column("lengths")[i].as_py(), "<i8"), n_docs, n_tokens)
                impact = IMPACT_UNIT * tf // (1000 * tf + 8 * m[doc])
                order = np.argsort((np.repeat(np.arange(len(sizes)), sizes) << 20) - impact, kind="stable")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1).cast(_INDEX_ARROW.field(c).type) for c in ("ids", "terms", "sizes")), pa.array([doc[order].astype("<i4").tobytes()]), pa.array([impact[order].astype("<i4").tobytes()])], schema=_INDEX_ARROW)

    return Index(settle(counts.drop("n_docs", "n_tokens").mapInArrow(sort, _INDEX), "search-index", _SMALL), n_docs, n_tokens)


def resolved(starts: np.ndarray, ends: np.ndarray, weight: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents of a shard that may be among the k best of an item, with their exact scores.

    List i is ``docs[starts[i]:ends[i]]`` with falling ``impacts``, of the given weight.
    ``bar`` is a score that k documents elsewhere have already, or 0. No document with a score
    of at least 1, of at least ``bar`` and of at least the k-th best is missing. Also returned:
    the number of postings read.
    """
    at, step = starts.copy(), FIRST_READ
    active = np.ones(len(starts), bool)
    while True:
        at = np.where(active, np.minimum(at + step, ends), at)
        step *= 2
        taken = at - starts
        which = np.repeat(np.arange(len(starts)), taken)
        place = np.arange(len(which)) + np.repeat(starts - (np.cumsum(taken) - taken), taken)
        doc = docs[place]
        stands = np.where(at < ends, weight * impacts[np.minimum(at, ends - 1)], 0)
        lower, known = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        np.add.at(lower, doc, weight[which] * impacts[place])
        np.add.at(known, doc, stands[which])
        upper = lower + (stands.sum() - known)
        least = max(1, bar, int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs >= k else 0)
        open_ = upper >= least
        if (lower[open_] == upper[open_]).all():
            found = np.flatnonzero(open_)
            return found, lower[found], len(which)
        shown = np.bincount(which[open_[doc]], minlength=len(starts))
        active = (at < ends) & (shown < int(open_.sum()))


def _best(ids: list, scores: list, k: int) -> tuple[list, list]:
    """The k largest scores with their ids; equal ones by id, nulls last."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]
    return [ids[i] for i in order], [scores[i] for i in order]


@dataclass(frozen=True)
class _Block:
    """Some items: each has a run of ``places`` into ``terms``, with weights times repeats."""

    items: pa.Array
    terms: pa.Array
    cuts: np.ndarray
    places: np.ndarray
    weights: np.ndarray


def _task(batches: Iterator[pa.RecordBatch], block: _Block, k: int) -> Iterator[pa.RecordBatch]:
    best: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for row in range(len(batch)):
            ids = batch.column("ids")[row].values
            sizes = batch.column("sizes")[row].values.to_numpy()
            docs, impacts = (np.frombuffer(batch.column(c)[row].as_py(), "<i4") for c in ("docs", "impacts"))
            impacts = impacts.astype(np.int64)
            cuts = np.append(0, np.cumsum(sizes, dtype=np.int64))
            held = pc.index_in(block.terms, value_set=batch.column("terms")[row].values.cast(block.terms.type))
            held = pc.fill_null(held, -1).to_numpy()
            for item in range(len(block.items)):
                span = slice(block.cuts[item], block.cuts[item + 1])
                list_, weight = held[block.places[span]], block.weights[span]
                list_, weight = list_[list_ >= 0], weight[list_ >= 0]
                if not len(list_):
                    continue
                have = best.get(item, ([], []))
                bar = have[1][-1] if len(have[1]) == k else 0
                found, score, _ = resolved(cuts[list_], cuts[list_ + 1], weight, docs, impacts, len(ids), k, bar)
                if len(found) > k:  # those that equal the k-th stay, as their ids decide
                    kept = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[kept], score[kept]
                if len(found):
                    best[item] = _best(have[0] + ids.take(pa.array(found)).to_pylist(), have[1] + score.tolist(), k)
    item = [i for i, (found, _) in best.items() for _ in found]
    yield pa.RecordBatch.from_arrays([block.items.take(pa.array(item, pa.int64())), pa.array([x for found, _ in best.values() for x in found], pa.int64()), pa.array([x for _, scores in best.values() for x in scores], pa.int64())], ["item_id", "doc_id", "score"])


def weighted(index: Index, items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, weight) of the items' terms that the index holds, settled; repeats are in the weight.

    Equal rows of items count once, and rows of one key with other texts are one item.
    """
    own = items.select(F.col(key).alias("item_id"), F.col(text).alias("text_")).distinct()
    times = settle(own.select("item_id", F.explode(terms("text_")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times")), "search-terms")
    wanted = settle(times.select("term").distinct(), "search-wanted")
    lists = index.shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("list")).select(F.col("list.terms").alias("term"), F.col("list.sizes").alias("size"))
    df = lists.join(marked(wanted), "term").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(WEIGHT_UNIT * F.log(F.lit(2 * index.n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return settle(times.join(df, "term").select("item_id", "term", (F.col("times") * weight).cast("long").alias("weight")).where("weight > 0"), "search-weights")


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0.

    Equal scores come by rising doc_id, null last. Items with null text, without terms, or
    with terms that no document holds have no rows, as has an empty table or index. A
    blocks's terms and weights are broadcast, ``BLOCK_TERMS`` of them or one item; with more
    of them the index is read once for each block.
    """
    spark = index.shards.sparkSession
    ship(spark)
    weights = weighted(index, items, key, text)
    blocks = max(1, -(-weights.count() // BLOCK_TERMS))
    out = None
    for number in range(blocks):
        part = weights.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toArrow().sort_by([("item_id", "ascending"), ("term", "ascending")]).combine_chunks()
        ids, terms_ = part.column("item_id").combine_chunks(), part.column("term").combine_chunks()
        coded, item = terms_.dictionary_encode(), ids.dictionary_encode(null_encoding="encode")
        item_of = item.indices.to_numpy(zero_copy_only=False)
        cuts = np.searchsorted(item_of, np.arange(len(item.dictionary) + 1))
        block = _Block(item.dictionary, coded.dictionary, cuts, coded.indices.to_numpy(zero_copy_only=False), part.column("weight").to_numpy())
        shared = spark.sparkContext.broadcast(block)
        kind = weights.schema["item_id"].dataType.simpleString()
        found = index.shards.mapInArrow(lambda batches, shared=shared: _task(batches, shared.value, k), f"item_id {kind}, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = out.withColumn("part_", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    some = parts.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part_").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's k best documents."""
    return search(build(docs), items, k)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS tokens FROM d WHERE len(ts) > 0),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
i AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
g AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens)))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0 QUALIFY rank <= 10
"""
