"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders.
Windows of such templates are joined by hash to the windows of the benchmark's items, so a
question whose numbers or names were changed still matches. A window's hash also says which
of its placeholders have equal fillers; so fillers of two matching windows stand for each
other one to one. All windows of a document that match one item then have to agree: every
filler of the item is bound to one filler of the document, and windows that say otherwise
don't count.

Only windows that a bitmap of the benchmark's hashes lets through leave a map task. The
bitmap has a fixed size, however large the benchmark is; a large benchmark lets more
windows through to the join, which decides. Of these only an item's rarest windows are
joined to all documents, as many as one of which a contaminated document must have; the
others are fetched for the pairs found. Texts are never shuffled.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm import textops as X
from lodestrata.runtime import marked, settle, ship

#: Tokens of a window, and those of them that may not be placeholders, or the window matches verbatim only.
SIZE, FLOOR = 8, 4
#: Items of fewer tokens are contained only in texts that have no other tokens.
LEAST = 4
#: Bits of the bitmap of windows: 8 MB.
WINDOW_BITS = 26
#: Different words of the benchmark whose hashes are broadcast at once, 32 MB; a benchmark with more is taken in blocks of items.
MOST_WORDS = 1 << 22
#: Words that are units where they follow a number.
UNITS = (
    "mm cm m km g kg mg t lb oz l ml s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years percent usd eur dollar dollars euro euros cent cents mph kmh mile miles meter meters metre metres foot feet inch inches"
).split()
_U = np.uint64
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TOKEN = _DIGIT.copy()
_TOKEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:\n"]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True
_NUMBER, _NAME, _UNIT, _WHOLE = (_U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0x8CB92BA72F3D8DD7))
_PIECE = 1 << 20


class Tokens(NamedTuple):
    """Per token: a hash of its folded bytes, and whether it is a number, a unit, capitalised; and the tokens before each text."""

    filler: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    capital: np.ndarray
    before: np.ndarray


def _unit_hashes() -> np.ndarray:
    size = np.array([len(u) for u in UNITS])
    ends = np.cumsum(size)
    return np.sort(X.hashes(np.frombuffer("".join(UNITS).encode(), np.uint8), ends - size, ends, fold=True))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of texts: runs of letters and digits, with points and commas between digits.

    Numbers begin with a digit; units are the words of ``UNITS`` behind a number of the same
    sentence. A capitalised token has more than one letter and a small second one. Case is
    folded for Latin letters. Long texts are taken in pieces cut at spaces.
    """
    parts, low, n, ended = [], 0, len(raw), True
    while low < n:
        high = min(n, low + _PIECE)
        row_end = int(offsets[np.searchsorted(offsets, high)])
        while high < row_end and raw[high] != 0x20:
            high += 1
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        part, ended = _piece(raw[low:high], inner, ended)
        parts.append((part[0] + low, *part[1:]))
        low = high
    if not parts:
        none = np.zeros(0, bool)
        return Tokens(np.zeros(0, _U), none, none, none, np.zeros(len(offsets), np.int64))
    starts, filler, number, capital, opens = (np.concatenate(x) for x in zip(*parts))
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~opens[1:] & ~number[1:]
    unit[unit] = np.isin(filler[unit], _unit_hashes())
    return Tokens(filler, number, unit, capital & ~unit, np.searchsorted(starts, offsets))


def _piece(raw: np.ndarray, edges: np.ndarray, ended: bool) -> tuple[tuple[np.ndarray, ...], bool]:
    """(start, filler, number, capital, opens a sentence) of each token, and whether a sentence ended behind the last one."""
    inside = _TOKEN[raw]
    if len(raw) > 2:
        inside[1:-1] |= _POINT[raw[1:-1]] & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]
    starts, ends, _ = X.runs(inside, np.concatenate([[0], edges[edges > 0], [len(raw)]]))
    folded = X.folded(raw)
    stops = np.concatenate([[0], np.cumsum(_SENTENCE_END[raw])])
    breaks = np.zeros(len(raw) + 1, np.int64)
    breaks[edges] += 1
    stops = stops + np.cumsum(breaks)  # a new text opens a sentence
    if not len(starts):
        return (starts, X.hashes(folded, starts, ends, fold=True), *[np.zeros(0, bool)] * 3), ended or bool(stops[-1] > 0)
    head = raw[starts]
    number = _DIGIT[head]
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = ((head >= 65) & (head <= 90) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)) & ~number
    capital &= ((second >= 97) & (second <= 122) | (second >= 128)) & (ends - starts > 1)
    opens = np.empty(len(starts), bool)
    opens[0] = ended or stops[starts[0]] > 0
    opens[1:] = stops[starts[1:]] > stops[ends[:-1] - 1]
    return (starts, X.hashes(folded, starts, ends, fold=True), number, capital, opens), bool(stops[-1] > stops[ends[-1] - 1])


class _Bits:
    """A set of hashes as a bitmap of fixed size: hashes in the set are always found, others seldom."""

    def __init__(self, hashes: DataFrame, bits: int) -> None:
        self.bits = bits
        place = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("place"))
        words = place.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most 2^(bits - 6) rows
        self.words = np.zeros(1 << (bits - 6), _U)
        self.words[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(_U)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> _U(64 - self.bits)
        return (self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) > 0


class _Words(NamedTuple):
    """Sorted hashes of the benchmark's words that stand in small letters, and of those capitalised."""

    small: np.ndarray
    large: np.ndarray


def _among(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _readings(t: Tokens, words: _Words) -> list[np.ndarray]:
    """Which tokens are names, in three readings of the same texts.

    First, capitalised tokens are names unless the benchmark has the word in small letters,
    and so are words in any case that the benchmark has with a capital only. Second, all
    capitalised tokens are names. Third, none is.
    """
    plain = ~(t.number | t.unit)
    small = np.zeros(len(plain), bool)
    small[plain] = _among(words.small, t.filler[plain])
    known = np.zeros(len(plain), bool)
    known[plain & ~small] = _among(words.large, t.filler[plain & ~small])
    return [(t.capital & ~small) | known, t.capital, np.zeros(len(plain), bool)]


def _ahead(marks: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marks)])


def _windows(t: Tokens, words: _Words, sizes: list[int], sieve: _Bits | None, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where windows start, their hashes, and the fillers of their placeholders, SIZE for each (0: none).

    Windows of SIZE tokens with FLOOR literal ones are hashed as templates, with the pairs
    of placeholders that have equal fillers; others by their words. A window is given once
    for each reading that makes it different. ``sizes`` are the lengths below SIZE whose
    windows are taken too, by their words; ``own``: only if they are the whole text.
    """
    counts, before = np.diff(t.before), t.before
    at = X.fitting(before, SIZE)
    if len(at):
        verbatim = X.mix(X.rolled(t.filler, SIZE, X.BASES[0])[at])
        seen: list[np.ndarray] = []
        for name in _readings(t, words):
            slot = t.number | t.unit | name
            use = np.ones(len(at), bool)
            for other in seen:
                change = _ahead(slot != other)
                use &= change[at + SIZE] > change[at]
            seen.append(slot)
            if not use.any():
                continue
            form = np.select([t.number, t.unit, name], [_NUMBER, _UNIT, _NAME], t.filler)
            h = X.mix(X.rolled(form, SIZE, X.BASES[0])[at] + _U(1))
            slots = _ahead(slot)
            exact = SIZE - (slots[at + SIZE] - slots[at]) < FLOOR
            h = np.where(exact, verbatim, h)
            keep = np.flatnonzero(use & sieve.has(h) if sieve is not None else use)
            a, h = at[keep], h[keep]
            fillers = np.where(slot[a[:, None] + np.arange(SIZE)], t.filler[a[:, None] + np.arange(SIZE)], _U(0))
            pattern = np.zeros(len(a), _U)
            for i in range(SIZE):
                for j in range(i + 1, SIZE):
                    pattern = (pattern << _U(1)) | ((fillers[:, i] == fillers[:, j]) & (fillers[:, i] > 0)).astype(_U)
            yield a, np.stack([h, X.mix(h ^ X.mix(pattern + _U(3)))], 1), fillers
    for k in sizes:
        a = before[:-1][counts == k] if own or k < LEAST else X.fitting(before, k)
        if not len(a):
            continue
        tag = X.mix(np.full(1, k, _U) ^ (_WHOLE if k < LEAST else _U(0)))
        h = X.mix(X.rolled(t.filler, k, X.BASES[0])[a] ^ tag)
        if sieve is not None:
            keep = sieve.has(h)
            a, h = a[keep], h[keep]
        yield a, np.stack([h, X.mix(h ^ tag)], 1), np.zeros((len(a), SIZE), _U)


_FOUND = "row long, id long, n long, hash long, sieve long, at binary, fillers binary"


def _found(rows: DataFrame, words: object, sizes: list[int], sieve: object | None, own: bool) -> DataFrame:
    """For each text and hash a row: where windows with that hash start, and their fillers.

    ``row`` tells rows apart, those with equal ids and texts as well; it doesn't depend on
    the order in which a partition's rows come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        times: collections.Counter[int] = collections.Counter()
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text"))
            ids = batch.column("id")
            for low, high in X.blocks(offsets):
                t = tokens(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                got = list(_windows(t, words.value, sizes, sieve.value if sieve is not None else None, own))
                if not sum(len(a) for a, _, _ in got):
                    continue
                at, h, fillers = (np.concatenate(x) for x in zip(*got))
                owner = X.row_of(at, t.before)
                order = np.lexsort((at, h[:, 1], owner))
                at, h, fillers, owner = at[order] - t.before[owner[order]], h[order], fillers[order], owner[order]
                first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (h[1:, 1] != h[:-1, 1])))
                cuts = np.append(first, len(at)).tolist()
                row = np.zeros(high - low, np.int64)
                for i in np.unique(owner).tolist():
                    key = xxhash.xxh3_64_intdigest(raw[offsets[low + i] : offsets[low + i + 1]].tobytes(), part) ^ hash(ids[low + i].as_py())
                    times[key] += 1
                    row[i] = np.int64(xxhash.xxh3_64_intdigest(f"{key} {times[key]}") >> 1)
                whose = owner[first]
                place = at.astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(row[whose]), ids.take(pa.array(whose + low)), pa.array(np.diff(t.before)[whose]),
                    pa.array(h[first, 1].view(np.int64)), pa.array(h[first, 0].view(np.int64)),
                    pa.array([place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([fillers[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ], ["row", "id", "n", "hash", "sieve", "at", "fillers"])

    return rows.mapInArrow(run, _FOUND)


def aligned(mine: dict[int, list[int]], theirs: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, hash) of matching windows, given the places of each hash.

    Places of the document are gone through in order. Where the item has a hash more than
    once, the place that goes on from the last match is taken, or else the first one; so
    the work is linear in the places.
    """
    at: dict[int, list[int]] = collections.defaultdict(list)
    for h, places in mine.items():
        for a in places:
            at[a].append(h)
    sets, first = {h: set(x) for h, x in theirs.items()}, {h: min(x) for h, x in theirs.items()}
    out: list[tuple[int, int, int]] = []
    ahead: int | None = None
    for a in sorted(at):
        here = [(a, a - ahead if ahead is not None and a - ahead in sets[h] else first[h], h) for h in at[a]]
        out += here
        ahead = a - min(b for _, b, _ in here)
    return out


def bound(pairs: list[tuple[int, int, list, list]]) -> tuple[int, int]:
    """How many places of the item match under one binding of its fillers, and how many with equal ones.

    ``pairs`` has (place in the document, place in the item, the item's fillers, the
    document's). Each window votes for what its fillers stand for; the most frequent pairs
    are bound, of equally frequent ones that which comes first in the document and then in
    the item, unless one side is bound already.
    """
    votes: dict[tuple, list] = {}
    for a, b, theirs, mine in pairs:
        for j, key in enumerate(zip(theirs, mine)):
            if key[0]:
                vote = votes.setdefault(key, [0, (a + j, b + j)])
                vote[0] -= 1
                vote[1] = min(vote[1], (a + j, b + j))
    stands: dict = {}
    taken = set()
    for (x, y), _ in sorted(votes.items(), key=lambda v: v[1]):
        if x not in stands and y not in taken:
            stands[x] = y
            taken.add(y)
    # a filler whose every reading was taken by others stands for nothing
    good = [(b, theirs, mine) for _, b, theirs, mine in pairs if all(stands.get(x) == y for x, y in zip(theirs, mine) if x)]
    return len({b for b, _, _ in good}), len({b for b, theirs, mine in good if theirs == mine})


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of one document and item."""
    columns = ("doc", "item", "doc_id", "item_id", "n", "hash", "at", "fillers", "item_at", "item_fillers")
    held: list[tuple] = []

    def told() -> tuple:
        places = lambda raw: np.frombuffer(raw, "<i4").tolist()
        mine, theirs, my, their = {}, {}, {}, {}
        for r in held:
            h = r[5]
            mine[h], theirs[h] = places(r[6]), places(r[8])
            my[h] = dict(zip(mine[h], np.frombuffer(r[7], _U).reshape(-1, SIZE).tolist()))
            their[h] = dict(zip(theirs[h], np.frombuffer(r[9], _U).reshape(-1, SIZE).tolist()))
        matched, same = bound([(a, b, their[h][b], my[h][a]) for a, b, h in aligned(mine, theirs)])
        n = held[0][4]
        return held[0][2], held[0][3], max(1, n - SIZE + 1), matched, same

    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and row[:2] != held[0][:2]:
                out.append(told())
                held = []
            held.append(row)
        if len(out) > 1000:
            yield _rows(out)
            out = []
    if held:
        out.append(told())
    yield _rows(out)


_OVERLAP = ["doc_id", "item_id", "item_windows", "matched", "verbatim"]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], _OVERLAP)


def _spelt(items: DataFrame) -> DataFrame:
    """(kind, hash): the different words of items in small letters (0) and capitalised (1), and the numbers of tokens below SIZE (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column("text"))
            for low, high in X.blocks(offsets):
                t = tokens(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                plain = ~(t.number | t.unit)
                small, large = np.unique(t.filler[plain & ~t.capital]), np.unique(t.filler[t.capital])
                count = np.unique(np.diff(t.before))
                count = count[(count > 0) & (count < SIZE)]
                kind = np.repeat([0, 1, 2], [len(small), len(large), len(count)]).astype(np.int32)
                value = np.concatenate([small, large, count.astype(_U)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(value)], ["kind", "hash"])

    return settle(items.mapInArrow(run, "kind int, hash long").distinct(), "benchmark-words")


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """(doc_id, item_id, item_windows, matched, verbatim) for pairs that share a window.

    ``matched`` counts the places of the item whose windows of ``SIZE`` tokens the document
    has under one binding of fillers, ``verbatim`` those with equal fillers. With a ``share``
    only pairs are given that may have so large a part of the item's windows: those that
    share one of its rarest windows (``_candidates``). Items of ``LEAST`` to SIZE - 1 tokens
    are one window that has to be found word for word; shorter ones are found in texts only
    that consist of the same tokens. Null and empty texts and items have no tokens and match
    nothing. Rows that repeat a doc_id give a row each, as do repeated items and items
    without an id; extra columns aren't looked at. Empty tables give an empty one.

    Whether a word is read as a name depends on the words of the benchmark, or, with more
    than ``MOST_WORDS`` different ones, on those of the item's block. Where an item has a
    window more than once, copies of it in a document are taken for the first one, unless
    they go on from the match before.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text")
    words = _spelt(items)
    blocks = max(1, -(-words.count() // MOST_WORDS))
    if blocks == 1:
        return _overlaps(docs, items, words, share)
    out = None
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number)
        found = _overlaps(docs, part, _spelt(part), share)
        out = found if out is None else out.unionByName(found)
    return out


def _overlaps(docs: DataFrame, items: DataFrame, words: DataFrame, share: float) -> DataFrame:
    spark = docs.sparkSession
    sizes = sorted(r[0] for r in words.where("kind = 2").select("hash").collect())  # numbers below SIZE
    sets = (np.sort(words.where(f"kind = {k}").select("hash").toArrow().column("hash").to_numpy().view(_U)) for k in (0, 1))
    known = spark.sparkContext.broadcast(_Words(*sets))
    theirs = settle(_found(items, known, sizes, None, True), "benchmark-windows")
    sieve = spark.sparkContext.broadcast(_Bits(theirs.select(F.col("sieve").alias("hash")), WINDOW_BITS))
    mine = _found(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), known, sizes, sieve, False)
    mine = mine.select(F.col("row").alias("doc"), F.col("id").alias("doc_id"), "hash", "at", "fillers")
    theirs = theirs.select(F.col("row").alias("item"), F.col("id").alias("item_id"), "n", "hash", F.col("at").alias("item_at"), F.col("fillers").alias("item_fillers"))
    if share > 0:
        mine = settle(mine, "document-windows")
        asked = theirs.join(_candidates(mine, theirs, share), "item")
        met = mine.join(asked, ["doc", "hash"])
    else:
        met = mine.join(theirs, "hash")
    dealt = met.repartition("doc", "item").sortWithinPartitions("doc", "item", "hash")
    return dealt.mapInArrow(_checked, ", ".join(f"{c} long" for c in _OVERLAP))


def _candidates(mine: DataFrame, theirs: DataFrame, share: float) -> DataFrame:
    """(doc, item) of all pairs that may share at least ``share`` of the item's windows.

    A document that has T of an item's W places has one of any W - T + 1 of them. So only
    those that the fewest documents have are joined, and a phrase that very many items and
    documents share makes no pairs unless it is most of an item.
    """
    df = mine.groupBy("hash").agg(F.count("*").alias("df"))
    width = F.greatest(F.lit(1), F.col("n") - SIZE + 1)
    count = (F.length("item_at") / 4).cast("int")
    # places are 32-bit numbers, least significant byte first
    byte = lambda i, k: F.conv(F.hex(F.substring(F.col("item_at"), i * 4 + k + 1, 1)), 16, 10).cast("int")
    place = lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216
    places = theirs.join(df, "hash", "left").select("item", "hash", width.alias("width"), F.coalesce("df", F.lit(0)).alias("df"), F.explode(F.transform(F.sequence(F.lit(0), count - 1), place)).alias("place"))
    cost = places.groupBy("item", "place").agg(F.sum("df").alias("cost"), F.first("width").alias("width"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("cost", "place"))
    rare = cost.withColumn("rank", rank).where(F.col("rank") <= F.col("width") - F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("width"))) + 1)
    keys = places.where("df > 0").join(rare.select("item", "place"), ["item", "place"]).select("item", "hash").distinct()
    return mine.select("doc", "hash").join(marked(settle(keys, "rare-windows")), "hash").select("doc", "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6) -> DataFrame:
    """The pairs of ``overlaps`` in which at least ``share`` of an item's windows are found."""
    return overlaps(docs, benchmark, share).where((F.col("matched") > 0) & (F.col("matched") >= share * F.col("item_windows")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.6) -> DataFrame:
    """The documents that contain no item of the benchmark.

    Rows without a doc_id are judged by their own text as well, by a key made for each text.
    """
    found = contaminated(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, share)
    lost = marked(settle(found.select("doc_id").distinct(), "contaminated"))
    return docs.join(lost, F.xxhash64(docs["doc_id"], docs["text"]) == lost["doc_id"], "left_anti")
