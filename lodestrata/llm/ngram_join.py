"""Similarity self-join on the Jaccard coefficient of word n-gram sets.

A MinHash LSH forest finds candidates: each document has a label of ``depth`` MinHash
values in each of several trees, and a tree's labels, sorted, are a prefix trie. In each
trie documents are first compared where their whole labels agree; then prefixes are
shortened level by level, in those subtrees only that aren't linked to one piece yet, until
a pair at the threshold would be missed in all trees with no more chance than the target
recall leaves. Sketches prune these pairs, and spanning trees of the rest make components.

Exact verification follows. Documents with equal sets are one class and take part once.
Classes are laid out in blocks in the order of component and label, and two blocks are
verified if a class of one has a common prefix with a class of its component in the other.
A block is compared with another by a matrix product, which gives back one row for each
class, never one for each pair. A long run of one prefix is split into pieces, and a large
group of near copies into blocks, so that no task holds more than two of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textops as X
from lodestrata.runtime import few, marked, settle, ship

#: Sketches agree in more than this share of places, or the pair isn't followed further.
#: With 64 places a pair at 0.8 falls below by chance once in more than 10^6 times.
_SKETCH, _ALIKE = 64, 0.55
#: Rows of a run of one prefix that are compared with each other in one task; a longer run
#: is dealt into pieces, and each pair of pieces is a task of its own.
RUN = 1 << 13
#: Classes, and n-grams, in a block that is verified at once.
BLOCK, BLOCK_GRAMS = 128, 1 << 20
_WIDE = 2  # bytes of a MinHash value in a label
_U = np.uint64


def depth_for(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct n-gram hashes of runs of texts, and where each text's begin.

    A text of fewer than n words, one at least, has its whole word sequence as its only
    n-gram; a text without words has none.
    """
    raw, offsets = X.utf8(texts)
    for low, high in X.blocks(offsets, 1 << 19):
        h, before = X.word_hashes(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        at, grams = X.windows(h, before, n)
        rows = X.row_of(at, before)
        count = np.diff(before)
        for k in range(1, n):  # short texts
            short = np.flatnonzero(count == k)
            if len(short):
                whole = h[before[short]].copy()
                for i in range(1, k):
                    whole = X.mix(whole + _U(i)) ^ h[before[short] + i]
                rows, grams = np.concatenate([rows, short]), np.concatenate([grams, X.mix(whole + _U(k << 8))])
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
        rows, grams = rows[fresh], grams[fresh]
        yield grams, np.searchsorted(rows, np.arange(high - low + 1))


def _minima(grams: np.ndarray, cuts: np.ndarray, places: int) -> np.ndarray:
    """MinHash values of each set: (sets, places) of 32 bits. Empty sets have all ones."""
    full = np.flatnonzero(np.diff(cuts))
    out = np.full((len(cuts) - 1, places), 0xFFFFFFFF, np.uint32)
    if not len(full):
        return out
    factors = np.random.default_rng(7).integers(1, 2**63, places, dtype=_U) * _U(2) + _U(1)
    low = (grams >> _U(32)) ^ grams
    at = cuts[full]
    for p in range(places):
        out[full, p] = np.minimum.reduceat(((low * factors[p]) >> _U(32)).astype(np.uint32), at)
    return out


def _class_of(grams: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set: two sums of mixed hashes."""
    total = lambda h: np.diff(np.concatenate([np.zeros(1, _U), np.cumsum(h, dtype=_U)])[cuts]).view(np.int64)
    return total(X.mix(grams)), total(X.mix(grams ^ _U(0x5851F42D4C957F2D)))


def _binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(raw.shape[1]), len(rows), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


_SIGNED = "doc_id long, row_a long, row_b long, text_key long, hi long, lo long, n_grams long, labels binary, sketch binary"
_CLASS = ["hi", "lo", "n_grams"]


def signatures(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """What of each text takes part in the search: its class, the labels of all trees, and a sketch.

    ``row_a`` and ``row_b`` stand for doc_id and text, ``text_key`` for the text.
    """
    ship(docs.sparkSession)
    places = max(trees * depth, _SKETCH)
    keys = ["doc_id", "row_a", "row_b", "text_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            low = 0
            for grams, cuts in _sets(whole.column("text"), n):
                m = _minima(grams, cuts, places)
                hi, lo = _class_of(grams, cuts)
                label = (X.mix(m[:, : trees * depth].astype(_U)) >> _U(48)).astype(">u2")
                sketch = X.mix(m[:, :_SKETCH].astype(_U)).astype(np.uint8)
                part = whole.slice(low, len(m))
                low += len(m)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(hi), pa.array(lo), pa.array(np.diff(cuts)), _binaries(label), _binaries(sketch)], [*keys, *_CLASS, "labels", "sketch"])

    a, b = _row_keys(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), a.alias("row_a"), b.alias("row_b"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, _SIGNED)


def _row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits for doc_id and text."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(11), text, doc_id)


def _entries(classes: DataFrame, trees: int, depth: int, level: int, *keep: str) -> DataFrame:
    """A row for each class and tree: ``key`` stands for the tree and the label's shortest prefix, ``label`` is the whole one."""
    wide = _WIDE * depth
    out = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    out = out.withColumn("label", F.expr(f"substring(labels, tree * {wide} + 1, {wide})"))
    return out.select(*keep, F.xxhash64("tree", F.expr(f"substring(label, 1, {_WIDE * level})")).alias("key"), "label")


def _linked(batches: Iterator[pa.RecordBatch], threshold: float, depth: int, level: int) -> Iterator[pa.RecordBatch]:
    """Edges between classes of each run of equal (key, x, y), rows being sorted by it and by label."""
    rest: pa.Table | None = None
    for batch in batches:
        got = pa.Table.from_batches([batch])
        got = pa.concat_tables([rest, got]) if rest is not None else got
        cols = [got.column(c).to_numpy() for c in ("key", "x", "y")]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        whole = int(change[-1]) if len(change) else 0
        if whole:
            yield _forest(got.slice(0, whole), threshold, depth, level)
        rest = got.slice(whole)
    if rest is not None:
        yield _forest(rest, threshold, depth, level)


def _rows_of(column: pa.ChunkedArray, wide: int, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, wide)


def _forest(rows: pa.Table, threshold: float, depth: int, level: int) -> pa.RecordBatch:
    """A spanning forest of the pairs of each run whose sketches agree.

    Pairs with the longest common prefixes are compared first. A subtree whose rows are one
    piece is left; else the prefix is shortened, down to ``level``. In a run of two pieces
    x and y only rows of different pieces are compared.
    """
    ids, n = rows.column("cid").to_numpy(), rows.num_rows
    key, x, y, piece, size = (rows.column(c).to_numpy() for c in ("key", "x", "y", "piece", "n_grams"))
    out_a, out_b = [], []
    change = np.logical_or.reduce([c[1:] != c[:-1] for c in (key, x, y)]) if n else np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, change)) if n else np.zeros(0, np.int64)
    length = np.diff(np.append(first, n))
    crowded = np.flatnonzero(np.repeat(length, length) > 1)
    if len(crowded):
        ids, key, x, y, piece, size = (c[crowded] for c in (ids, key, x, y, piece, size))
        sketch = _rows_of(rows.column("sketch"), _SKETCH, crowded)
        words = _rows_of(rows.column("label"), _WIDE * depth, crowded).view(">u2").astype(np.uint16)
        n = len(ids)
        apart = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in (key, x, y)]))
        run_low, run_high = _bounds(apart)
        label, ahead = np.arange(n), np.arange(n) + 1
        for k in range(depth, level - 1, -1):
            edge = apart.copy()
            edge[1:] |= (words[1:, :k] != words[:-1, :k]).any(1)
            low, high = _bounds(edge)
            begin = np.flatnonzero(edge)
            one = np.minimum.reduceat(label, begin) == np.maximum.reduceat(label, begin)
            left = np.flatnonzero((ahead < high) & ~np.repeat(one, np.diff(np.append(begin, n))))
            while len(left):
                right = ahead[left]
                fits = (label[left] != label[right]) & (np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]))
                fits &= (x[left] == y[left]) | (piece[left] != piece[right])
                some = np.flatnonzero(fits)
                a, b = left[some], right[some]
                alike = (sketch[a] == sketch[b]).mean(1) > _ALIKE
                for p, q in zip(a[alike].tolist(), b[alike].tolist()):
                    if label[p] != label[q]:
                        out_a.append(ids[p]), out_b.append(ids[q])
                        part = label[run_low[p] : run_high[p]]
                        part[part == label[q]] = label[p]
                ahead[left] += 1
                left = left[ahead[left] < high[left]]
            ahead = np.maximum(ahead, high)
    a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _bounds(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row where its run begins and ends, given which rows begin one."""
    begin = np.flatnonzero(edge)
    length = np.diff(np.append(begin, len(edge)))
    return np.repeat(begin, length), np.repeat(begin + length, length)


def candidates(classes: DataFrame, threshold: float, trees: int, depth: int, level: int) -> DataFrame:
    """Edges (a, b) between the ``cid`` of classes that the forest finds alike.

    A run of more than ``RUN`` rows of one prefix is dealt into pieces by hash, and every
    pair of pieces is compared by a task of its own.
    """
    rows = _entries(classes.where("n_grams > 0"), trees, depth, level, "cid", "n_grams", "sketch")
    long = settle(rows.groupBy("key").count().where(F.col("count") > RUN).select(F.col("key").alias("long"), F.ceil(F.col("count") / RUN).cast("int").alias("pieces")), "long-runs")
    rows = rows.join(marked(long), F.col("key") == F.col("long"), "left")
    rows = rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("cid"), "pieces").cast("int"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    rows = rows.select("cid", "n_grams", "sketch", "key", "label", "piece", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"))
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "label", "n_grams", "cid")
    return dealt.mapInArrow(lambda batches: _linked(batches, threshold, depth, level), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge: root is the smallest id that edges lead to.

    Each round links every node to the smallest node beside it, replaces edges by those
    between the nodes linked to, and ends when none is left; the rounds are written to the
    shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = settle(edges.select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")), "up")
        # many nodes point to one, so their table is broadcast unless it is large; then adaptive execution splits the join
        near = F.broadcast if few(up) else lambda df: df
        # a second step upwards shortens chains
        tops = up.select(F.col("a").alias("mid"), F.col("up").alias("top"))
        step = settle(up.join(near(tops), F.col("up") == F.col("mid"), "left").select("a", F.coalesce("top", "up").alias("up")), "step")
        if labels is None:
            labels = step.select(F.col("a").alias("id"), F.col("up").alias("root"))
        else:
            labels = settle(labels.join(near(step), labels["root"] == step["a"], "left").select("id", F.coalesce("up", "root").alias("root")), "labels")
        left = step.select(F.col("a").alias("la"), F.col("up").alias("ua"))
        right = step.select(F.col("a").alias("lb"), F.col("up").alias("ub"))
        moved = edges.join(near(left), F.col("a") == F.col("la")).join(near(right), F.col("b") == F.col("lb"))
        edges = settle(moved.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def blocked(members: DataFrame) -> DataFrame:
    """Adds ``block``: consecutive rows in the order of root and label, as many as a block may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, grams = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for size in batch.column("n_grams").to_pylist():
                if rows == BLOCK or (rows and grams + size > BLOCK_GRAMS):
                    block, rows, grams = block + 1, 0, 0
                rows, grams = rows + 1, grams + size
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "block"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    ordered = members.repartitionByRange("root", "labels", "cid").sortWithinPartitions("root", "labels", "cid")
    return ordered.mapInArrow(run, f"{kinds}, block long")


def meetings(members: DataFrame, trees: int, depth: int, level: int) -> DataFrame:
    """(x, y): each block with itself, and with every later one in which a class of the same component has a common prefix."""
    alone = members.select(F.col("block").alias("x"), F.col("block").alias("y")).distinct()
    ends = members.groupBy("root").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    wide = settle(ends.where("least < most").select(F.col("root").alias("wide")), "wide")
    entries = _entries(members.join(marked(wide), F.col("root") == F.col("wide"), "left_semi"), trees, depth, level, "root", "block")
    # one key of both, so that the rows of a large component don't stay where the join may have brought them
    runs = entries.groupBy(F.xxhash64("key", "root").alias("run")).agg(F.sort_array(F.collect_set("block")).alias("blocks")).where(F.size("blocks") > 1)
    pairs = runs.select("blocks", F.posexplode("blocks").alias("at", "x")).where(F.col("at") < F.size("blocks") - 1)
    return alone.unionByName(pairs.select("x", F.explode(F.expr("slice(blocks, at + 2, size(blocks))")).alias("y")).distinct())


def gram_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(hi, lo, grams): the n-gram hashes of each member, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()  # no more than a partition's rows
        for batch in batches:
            for grams, cuts in _sets(batch.column("text"), n):
                found = [(i, hi, lo) for i, (hi, lo) in enumerate(zip(*(c.tolist() for c in _class_of(grams, cuts)))) if (hi, lo) not in known and not known.add((hi, lo))]
                values = [grams[cuts[i] : cuts[i + 1]].tobytes() for i, _, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array(values, pa.binary())], ["hi", "lo", "grams"])

    keys = settle(members.select(F.col("text_key").alias("wanted")).distinct(), "texts")
    texts = docs.select("text").join(marked(keys), F.xxhash64("text") == F.col("wanted"), "left_semi")
    return texts.mapInArrow(run, "hi long, lo long, grams binary").dropDuplicates(["hi", "lo"])


def _verified(rows: pa.Table, num: int, den: int) -> pa.Table:
    """Links of one pair of blocks: for each class the number of classes and documents, and a forest of edges."""
    same = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
    ids, copies, block = (rows.column(c).to_numpy() for c in ("cid", "copies", "block"))
    sets = [np.frombuffer(g, _U) for g in rows.column("grams").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(ids)), size)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del sets
    shared = times[place] > 1
    place, owner = place[shared], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    _, place = np.unique(place, return_inverse=True)
    common = np.zeros((len(ids), len(ids)), np.float32)
    width = 1 << 13
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):  # bounded memory for long texts
        a, b = np.searchsorted(place, [low, low + width])
        m = np.zeros((len(ids), min(width, int(place[b - 1]) - low + 1)), np.float32)
        m[owner[a:b], place[a:b] - low] = 1
        common += m @ m.T
    inter = common.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    link = (inter * den >= union * num) & (inter > 0)
    if same:
        np.fill_diagonal(link, False)
    else:
        link &= block[:, None] != block[None, :]
    parent = np.arange(len(ids))
    for p, q in zip(*np.nonzero(np.triu(link))):
        p, q = _find(parent, int(p)), _find(parent, int(q))
        if p != q:
            parent[max(p, q)] = min(p, q)
    roots = np.array([_find(parent, i) for i in range(len(ids))], np.int64)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    return pa.table({"cid": pa.array(ids), "links": pa.array(link.sum(1).astype(np.int64)), "docs": pa.array((link * copies[None, :]).sum(1).astype(np.int64)), "to": pa.array(least[roots])})


def _joined(docs: DataFrame, n: int, threshold: tuple[int, int], trees: int, depth: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and for each class what ``join`` tells of it and the ``root`` of its group."""
    num, den = threshold
    level = depth_for(trees, depth, num / den, recall)
    signed = settle(signatures(docs, n, trees, depth), "signatures")
    named = signed.groupBy(*_CLASS).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("text_key").alias("text_key"), F.min("labels").alias("labels"), F.min("sketch").alias("sketch"))
    classes = settle(named.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = components(candidates(classes, num / den, trees, depth, level)).withColumnRenamed("id", "cid")
    members = settle(blocked(classes.join(roots, "cid").select("cid", *_CLASS, "copies", "text_key", "labels", "root")), "members")
    sets = members.join(gram_sets(docs, members, n), ["hi", "lo"]).select("cid", "copies", "block", "grams")
    met = meetings(members, trees, depth, level).withColumn("side", F.explode(F.array_distinct(F.array("x", "y"))))
    pairs = met.join(sets, F.col("side") == F.col("block")).select("x", "y", "cid", "copies", "block", "grams")
    told = settle(pairs.groupBy("x", "y").applyInArrow(lambda rows: _verified(rows, num, den), "cid long, links long, docs long, to long"), "verified")
    counts = told.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    tied = components(told.where("cid <> to").select(F.col("to").alias("a"), F.col("cid").alias("b")))
    tied = tied.select(F.col("id").alias("cid"), "root")
    least = tied.join(classes.select("cid", "class_id"), "cid").groupBy("root").agg(F.min("class_id").alias("group_id"))
    facts = classes.select("cid", *_CLASS, "class_id", "copies").join(counts, "cid", "left").join(tied.join(least, "root"), "cid", "left").select(
        *_CLASS, "class_id", F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("root", "cid").alias("root"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_class_links"),
    )
    return signed, facts


def join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 24, depth: int = 8, recall: float = 0.9999) -> DataFrame:
    """One row for each document: (doc_id, class_id, group_id, n_links, n_class_links).

    Words are runs of characters other than space and tab to carriage return, unchanged.
    A link joins two documents whose sets of n consecutive words have a Jaccard coefficient
    of at least ``threshold`` (a fraction as two integers). ``class_id`` is the smallest
    doc_id with the same set, ``n_links`` the number of other documents linked, those of
    the same class included, ``n_class_links`` the number of other classes linked, and
    ``group_id`` the smallest doc_id that can be reached over links.

    A text of one to n-1 words has its word sequence as its only n-gram. Texts that are
    null or without words form one class, without links to others. Repeated rows count as
    documents of one class, rows with one doc_id and different texts as documents of their
    own; a document without doc_id is linked like others, but gives its class and group no
    id unless no member has one. Other columns of the input aren't looked at. An empty
    table gives an empty one.
    """
    signed, facts = _joined(docs, n, threshold, trees, depth, recall)
    return signed.select("doc_id", *_CLASS).join(facts, _CLASS).select("doc_id", "class_id", "group_id", "n_links", "n_class_links")


def keep_one(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 24, depth: int = 8, recall: float = 0.9999) -> DataFrame:
    """The documents, of each group of linked ones only that with the smallest doc_id.

    A document without doc_id stays only if its group has no other; among several, and
    among different texts of one doc_id, hashes decide. Texts that are null or without
    words are one class, so one of them stays. Of repeated rows one stays.
    """
    signed, facts = _joined(docs, n, threshold, trees, depth, recall)
    rows = settle(signed.select("doc_id", "row_a", "row_b", *_CLASS).join(facts.select(*_CLASS, "root"), _CLASS).select("doc_id", "row_a", "row_b", "root"), "grouped")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_a", "row_b")).alias("best")
    shared = settle(rows.groupBy("root").agg(best, F.count("*").alias("held")).where("held > 1").select("root", "best"), "groups")
    lost = rows.join(marked(shared), "root").where("row_a <> best.row_a OR row_b <> best.row_b").select(F.col("row_a").alias("lost_a"), F.col("row_b").alias("lost_b"))
    again = rows.groupBy("row_a", "row_b").count().where("count > 1").select(F.col("row_a").alias("again_a"), F.col("row_b").alias("again_b"))
    lost, again = settle(lost.distinct(), "lost"), settle(again, "again")
    lost, again = marked(lost), marked(again)
    a, b = _row_keys(docs["doc_id"], docs["text"])
    kept = docs.join(lost, (a == lost["lost_a"]) & (b == lost["lost_b"]), "left_anti")
    if again.isEmpty():
        return kept
    a, b = _row_keys(kept["doc_id"], kept["text"])
    twice = (a == again["again_a"]) & (b == again["again_b"])
    once = kept.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, twice, "left_anti").unionByName(once)
