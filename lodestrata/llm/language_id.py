"""Language identification by character language models with Kneser-Ney smoothing.

A text is taken as its words: runs of letters and marks, in lower case. Each word is read
behind start signs and up to an end sign, and a model gives every sign a probability from
the signs before it. The language whose model needs the fewest nats a sign wins.

The counts come from all learnt rows. Each task counts the signs of its different words,
and Spark adds the counts up; what is counted on the lower levels, the different signs seen
before a run, is aggregated in Spark too. The models are the interpolated ones of Kneser
and Ney, one discount for each language and level, kept as sorted arrays of hashes beside
probabilities and back-off weights, and broadcast where no level has more than
``max_grams`` runs. Larger models stay in tables, whole: the different runs of the texts
meet them in joins, and each block of texts gets the probabilities of its own runs back.

How sure a prediction is, and how many nats a sign are too many for a language, is learnt
from a tenth of the labelled rows, which the counts leave aside at first, and from all of
these. The models that judge are made of the counts of all learnt rows.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textops as X
from lodestrata.llm.quality import calibrated
from lodestrata.operators.aggregates import exact_quantiles
from lodestrata.runtime import extended, marked, settle, ship

#: Signs in a run: each is predicted from the four before it.
ORDER = 5
START, END = "\x02", "\x03"
#: No language: the text is null or has no letter.
UNKNOWN = "und"
#: Bytes of text that are worked on at once.
_BLOCK = 1 << 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Steps in which a unit of a margin's logarithm is counted.
_STEPS = 1024.0
#: A block of texts is a row group by itself, without statistics, so that one is held at a time.
_BLOCKS = {"compression": "zstd", "parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.column.statistics.enabled": "false"}


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark, else 0."""
    points = [chr(i) for i in range(0x110000)]
    kinds = np.fromiter((c.isalpha() for c in points), bool, len(points)).astype(np.uint8) * 2
    kinds[[i for i in range(0x300, 0x110000) if not 0xD800 <= i < 0xE000 and not kinds[i] and unicodedata.category(points[i])[0] == "M"]] = 1
    return kinds


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 bytes begin, and their code points."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[lead].astype(np.uint32)
    out = first.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((first >= low) & (first < high))
        value = first[at] & mask
        for i in range(1, more + 1):
            value = value << np.uint32(6) | (raw[lead[at] + i] & 0x3F)
        out[at] = value
    return lead, out


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of each text with a letter, the words before each text, and whether each text has a letter."""
    lead, points = code_points(raw)
    kind = _kinds()[points]
    inside = np.repeat(kind > 0, np.diff(np.append(lead, len(raw))))
    starts, ends, before = X.runs(inside, offsets)
    letters = np.append(0, np.cumsum(kind == 2))[np.searchsorted(lead, offsets)]
    cuts = np.append(0, np.cumsum(ends - starts))
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[inside])])
    return tokens.dictionary_encode(), before, np.diff(letters) > 0


def signs(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case as one sequence of signs, where its predicted signs are, and their words."""
    raw, offsets = X.utf8(pc.utf8_lower(found))
    lead, points = code_points(raw)
    at = np.searchsorted(lead, offsets)
    size = np.diff(at)
    begin = np.append(0, np.cumsum(size + ORDER))
    sequence = np.full(begin[-1], ord(START), np.uint32)
    word = np.repeat(np.arange(len(size)), size)
    sequence[np.arange(len(points)) - at[word] + begin[word] + ORDER - 1] = points
    sequence[begin[1:] - 1] = ord(END)
    predicted = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(predicted)) + np.repeat(begin[:-1] + ORDER - 1 - np.append(0, np.cumsum(size + 1))[:-1], size + 1)
    return sequence, place, predicted


def run_hashes(sequence: np.ndarray) -> list[np.ndarray]:
    """For each number k of signs up to ``ORDER`` the hash of the k signs that end at each place."""
    code = sequence.astype(_U) + _U(1)
    out = [np.full(len(code), _STEP)]
    for k in range(1, ORDER + 1):
        h = out[-1] * _STEP
        h[k - 1 :] += code[: len(code) - k + 1]
        out.append(X.mix(h))
    return out


def _gram_hashes(grams: np.ndarray) -> list[np.ndarray]:
    """The same for the last signs of each row of a matrix of code points."""
    out = [np.full(len(grams), _STEP)]
    for k in range(1, grams.shape[1] + 1):
        out.append(X.mix(out[-1] * _STEP + grams[:, -k].astype(_U) + _U(1)))
    return out


@dataclass(frozen=True)
class Level:
    """Sorted hashes of runs with log probabilities, and of contexts with log back-off weights."""

    runs: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_back: np.ndarray


@dataclass(frozen=True)
class Models:
    """A model for each language, level by level; the probability of an unknown sign; calibration.

    Where runs were left out of the levels, ``whole`` has a pair of tables for each level: of
    each run the log probability by the language's number, and of each context the log
    back-off weight. These are what texts are judged by then.
    """

    languages: list[str]
    levels: list[list[Level]]
    log_unknown: float
    slope: float = 1.0
    offset: float = 0.0
    means: tuple[float, ...] = ()
    limits: tuple[float, ...] = ()
    whole: tuple[tuple[DataFrame, DataFrame], ...] = ()


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def log_probabilities(levels: list[Level], hashes: list[np.ndarray], contexts: list[np.ndarray], log_unknown: float) -> np.ndarray:
    """Log probabilities of signs, given the hashes of the runs that end there and of their contexts."""
    out = np.zeros(len(hashes[0]))
    todo = np.arange(len(out))
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        at = _find(level.runs, hashes[k][todo])
        out[todo[at >= 0]] += level.log_p[at[at >= 0]]
        todo = todo[at < 0]
        back = _find(level.contexts, contexts[k - 1][todo])
        out[todo[back >= 0]] += level.log_back[back[back >= 0]]
    out[todo] += log_unknown
    return out


def is_held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _aside() -> Column:
    """A tenth of the labelled rows, which calibrate."""
    return F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(10)) == 0


def _grams(sequence: np.ndarray, place: np.ndarray) -> pa.Array:
    """The runs of ``ORDER`` signs that end at some places."""
    grams = np.stack([sequence[place - back] for back in range(ORDER - 1, -1, -1)], axis=1).astype("<u4")
    return pa.array(np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel(), pa.string())


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of ``ORDER`` signs stands in the words of each language's texts."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            own = langs.indices.to_numpy(zero_copy_only=False)
            raw, offsets = X.utf8(batch.column("text"))
            for low, high in X.blocks(offsets, _BLOCK):
                coded, before, _ = words(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n = len(coded.dictionary)
                if not n:
                    continue
                key = np.repeat(own[low:high].astype(np.int64), np.diff(before)) * n + coded.indices.to_numpy()
                times = np.bincount(key, minlength=n * len(langs.dictionary)).reshape(-1, n)
                sequence, place, word = signs(coded.dictionary)
                _, first, which = np.unique(run_hashes(sequence)[ORDER][place], return_index=True, return_inverse=True)
                texts = _grams(sequence, place[first])
                for lang in np.flatnonzero(times.any(1)):
                    count = np.bincount(which, times[lang][word], len(first)).astype(np.int64)
                    some = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[lang].as_py()] * len(some), pa.string()), texts.take(pa.array(some)), pa.array(count[some])], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _kept(grams: DataFrame, most: int) -> DataFrame:
    """Of each language and level the runs with the largest counts, ``most`` of them at most; runs whose counts are about equal stay or go together."""
    step = F.floor(16 * F.log2("n"))
    steps: dict[tuple[str, int], dict[int, int]] = {}
    for r in grams.groupBy("lang", "level", step.alias("step")).count().collect():  # some hundreds of steps for each
        steps.setdefault((r["lang"], r["level"]), {})[r["step"]] = r["count"]
    cut: list[Column] = []
    for (lang, level), own in steps.items():
        total, least = 0, max(own) + 1
        for s in sorted(own, reverse=True):
            total += own[s]
            if total > most:
                break
            least = s
        if least != min(own):
            cut.append((F.col("lang") == lang) & (F.col("level") == level) & (step < least))
    return grams.where(~functools.reduce(Column.__or__, cut)) if cut else grams


def _level(grams: np.ndarray, count: np.ndarray, total: np.ndarray, discount: float, below: list[Level], log_unknown: float) -> Level:
    """The arrays of one level from the kept runs with their counts and those of their contexts."""
    h = _gram_hashes(grams)
    context = _gram_hashes(grams[:, :-1])[-1]
    p = (count - discount) / total
    contexts, first, which = np.unique(context, return_index=True, return_inverse=True)
    back = np.maximum(1 - np.bincount(which, p, len(contexts)), 1e-300)
    shorter = [_gram_hashes(grams[:, at:-1])[-1] for at in range(grams.shape[1] - 1, 0, -1)]
    lower = log_probabilities(below, h, shorter, log_unknown)
    log_p = np.log(p + back[which] * np.exp(lower))
    order = np.argsort(h[-1])
    return Level(h[-1][order], log_p[order], contexts, np.log(back))


def _whole(every: DataFrame, discounts: list[tuple[str, int, int, float]], log_unknown: float) -> tuple[tuple[DataFrame, DataFrame], ...]:
    """The tables of all runs and contexts of each level, from the shortest runs up."""
    few = every.sparkSession.createDataFrame(discounts, "lang string, level int, at int, discount double")
    own = every.join(F.broadcast(few), ["lang", "level"])
    own = own.select("lang", "at", "level", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("p"), (F.col("discount") * F.col("kinds") / F.col("total")).alias("back"))
    out: list[tuple[DataFrame, DataFrame]] = []
    lower = None
    for k in range(1, ORDER + 1):
        part = own.where(F.col("level") == k)
        if lower is None:
            part = part.withColumn("below", F.lit(log_unknown))
        else:  # what stands behind a run's first sign was counted on the level below
            shorter = lower.select("at", F.col("gram").alias("shorter"), F.col("log_p").alias("below"))
            part = part.withColumn("shorter", F.expr("substring(gram, 2)")).join(shorter, ["at", "shorter"])
        lower = settle(part.select("at", "gram", F.log(F.col("p") + F.col("back") * F.exp("below")).alias("log_p"), F.log("back").alias("log_back")), "level")
        held = lambda rows, key, value: settle(rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", value))).alias(value)), "held")  # an entry for each language
        contexts = lower.groupBy(F.substring("gram", 1, k - 1).alias("context"), "at").agg(F.first("log_back").alias("log_back"))
        out.append((held(lower, "gram", "log_p"), held(contexts, "context", "log_back")))
    return tuple(out)


def learn(docs: DataFrame, max_grams: int = 1 << 19) -> Models:
    """Models of all values of ``lang`` on the rows that are neither held out nor aside.

    Rows without doc_id, lang or text aren't learnt from, and repeated ones count as often as
    they are there. A language without a word in its rows isn't learnt. An empty table gives
    no languages. ``max_grams`` bounds the runs of a level that ``levels`` hold, over all
    languages; with more of them the models are ``whole`` as tables.
    """
    return _fitted(settle(gram_counts(_learnt(docs).where(~_aside()).select("lang", "text")), "grams"), max_grams)


def _learnt(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out())


def _fitted(grams: DataFrame, max_grams: int = 1 << 19) -> Models:
    """Models from the settled counts of ``gram_counts``."""
    tables = [grams]
    for _ in range(1, ORDER):  # on lower levels, how many different signs stand before a run
        tables.append(settle(tables[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "grams"))
    every = functools.reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(ORDER - i)) for i, t in enumerate(tables)])
    context = F.expr("substring(gram, 1, level - 1)")
    sums = every.groupBy("lang", "level", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    every = settle(every.withColumn("context", context).join(sums, ["lang", "level", "context"]).drop("context"), "grams")
    few = {(r["lang"], r["level"], r["n"]): r["count"] for r in every.where("n <= 2").groupBy("lang", "level", "n").count().collect()}
    languages = sorted(r["lang"] for r in every.where("level = 1").select("lang").distinct().collect())
    levels: list[list[Level]] = [[] for _ in languages]
    if not languages:
        return Models([], [], 0.0)
    log_unknown = -float(np.log(tables[-1].select("gram").distinct().count() + 1))
    discounts = {}
    for lang in languages:
        for k in range(1, ORDER + 1):
            once, twice = few.get((lang, k, 1), 0), few.get((lang, k, 2), 0)
            discounts[lang, k] = once / (once + 2 * twice) if once and twice else 0.5
    kept = _kept(every, max(1, max_grams // len(languages))).drop("kinds").toArrow()
    for k in range(1, ORDER + 1):
        held = kept.filter(pc.equal(kept.column("level"), k)).sort_by([("lang", "ascending"), ("gram", "ascending")])
        owner = np.array(held.column("lang").to_pylist(), object)
        points = np.frombuffer("".join(held.column("gram").to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, k)
        count, total = (held.column(c).to_numpy().astype(np.float64) for c in ("n", "total"))
        for i, lang in enumerate(languages):
            mine = np.flatnonzero(owner == lang)
            levels[i].append(_level(points[mine], count[mine], total[mine], discounts[lang, k], levels[i], log_unknown))
    whole = () if len(kept) == every.count() else _whole(every, [(lang, k, languages.index(lang), d) for (lang, k), d in discounts.items()], log_unknown)
    return Models(languages, levels, log_unknown, whole=whole)


def entropies(raw: np.ndarray, offsets: np.ndarray, models: Models, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats a sign of each text in each language (texts x languages), the number of signs, and whether there is a letter.

    ``known``: sorted hashes of all runs of the texts, and their log probabilities by
    language, which take the place of the models' levels.
    """
    coded, before, letter = words(raw, offsets)
    sequence, place, word = signs(coded.dictionary)
    n, rows = len(coded.dictionary), len(offsets) - 1
    hashes = run_hashes(sequence)
    _, first, which = np.unique(hashes[ORDER][place], return_index=True, return_inverse=True)  # each run is looked up once
    here, back = [h[place[first]] for h in hashes], [h[place[first] - 1] for h in hashes]
    row, code = np.repeat(np.arange(rows), np.diff(before)), coded.indices.to_numpy()
    size = np.bincount(row, np.bincount(word, minlength=n)[code], rows)
    out = np.zeros((rows, len(models.languages)))
    for i in range(len(models.languages)):
        log_p = log_probabilities(models.levels[i], here, back, models.log_unknown) if known is None else known[1][_find(known[0], here[ORDER]), i]
        nats = -np.bincount(word, log_p[which], n)
        out[:, i] = np.bincount(row, nats[code], rows) / np.maximum(size, 1)
    return out, size.astype(np.int64), letter


def _judged(raw: np.ndarray, offsets: np.ndarray, models: Models, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of each text the language's number (-1: none), nats a sign, signs, and the nats by which the next language is worse."""
    nats, size, letter = entropies(raw, offsets, models, known)
    if not models.languages:
        return np.full(len(size), -1), np.zeros(len(size)), size, np.zeros(len(size))
    best = nats.argmin(1)
    least = nats[np.arange(len(size)), best]
    rest = nats.copy()
    rest[np.arange(len(size)), best] = np.inf
    margin = np.minimum(rest.min(1) - least, 1e6) * size
    return np.where(letter, best, -1), least, size, margin


def _sure(margin: np.ndarray, models: Models) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(models.slope * np.log1p(margin) + models.offset, -30, 30)))


def calibrate(docs: DataFrame, models: Models, reject: float = 0.002) -> Models:
    """Learns how sure a margin makes, and the nats a sign that all but ``reject`` of a language's texts need at most.

    The spread of nats a sign falls with the root of the number of signs, so the limit is put
    on their distance from the language's mean, times that root; it is four standard
    deviations at least, as few rows have no rare ones. All rows aside are used. Spark counts
    them by steps of the margin's logarithm, and sums and quantiles are taken for each language.
    """
    if not models.languages:
        return models
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out() & _aside()).select("lang", "text")
    got = settle(identify(rows, models, detail=True).where(f"lang_pred != '{UNKNOWN}'").select((F.col("lang") == F.col("lang_pred")).alias("right"), "lang", "cross_entropy", "n_signs", "margin"), "aside")
    steps = got.groupBy("right", F.round(F.log1p("margin") * _STEPS).cast("long").alias("step")).count().toArrow().sort_by([("right", "ascending"), ("step", "ascending")])
    step, right, times = (steps.column(c).to_numpy().astype(np.float64) for c in ("step", "right", "count"))
    slope, offset = calibrated(step / _STEPS, right, times)
    own = got.where("right")
    exact = lambda c: F.sum(F.round(c, 9).cast("decimal(38,9)")).cast("double")  # in any order
    means = {r["lang"]: r["mean"] for r in own.groupBy("lang").agg((exact(F.col("cross_entropy") * F.col("n_signs")) / F.sum("n_signs")).alias("mean")).collect()}
    mean = functools.reduce(lambda c, m: F.when(F.col("lang") == m[0], m[1]).otherwise(c), means.items(), F.lit(0.0))
    apart = own.select("lang", ((F.col("cross_entropy") - mean) * F.sqrt("n_signs")).alias("apart"))
    spread = {r["lang"]: r["spread"] for r in apart.groupBy("lang").agg(F.round(F.stddev_pop("apart"), 9).alias("spread")).collect()}
    rare = {r["lang"]: r["q"] for r in exact_quantiles(apart, ["lang"], "apart", {"q": 1 - reject}).collect()}
    limits = tuple(max(rare[name], 4 * spread[name]) if name in rare else float("inf") for name in models.languages)
    return replace(models, slope=slope, offset=offset, means=tuple(means.get(name, 0.0) for name in models.languages), limits=limits)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, each with the different runs of its texts."""
    for batch in batches:
        raw, offsets = X.utf8(batch.column("text"))
        for low, high in X.blocks(offsets, _BLOCK):
            coded, _, _ = words(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            sequence, place, _ = signs(coded.dictionary)
            _, first = np.unique(run_hashes(sequence)[ORDER][place], return_index=True)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch.slice(low, high - low))
            grams = _grams(sequence, place[first])
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), grams)], ["block", "rows", "grams"])


def run_probabilities(grams: DataFrame, models: Models) -> DataFrame:
    """(gram, log_p): of each of the runs the log probability in each language, from the tables of whole models."""
    value: list[tuple[str, str]] = []
    out = grams
    for k, (runs, contexts) in enumerate(models.whole, 1):
        value.append((f"p{k}_", f"back{k}_"))
        out = out.withColumn("end_", F.substring("gram", ORDER + 1 - k, k)).withColumn("before_", F.substring("gram", ORDER + 1 - k, k - 1))
        out = out.join(marked(runs.select(F.col("gram").alias("end_"), F.col("log_p").alias(f"p{k}_"))), "end_", "left")
        out = out.join(marked(contexts.select(F.col("context").alias("before_"), F.col("log_back").alias(f"back{k}_"))), "before_", "left").drop("end_", "before_")

    def of(i: Column) -> Column:
        log_p = F.lit(models.log_unknown)
        for p, back in value:  # the longest run that is known counts, behind the back-off of those that aren't
            log_p = F.coalesce(F.try_element_at(p, i), F.coalesce(F.try_element_at(back, i), F.lit(0.0)) + log_p)
        return log_p

    return out.select("gram", F.array(*(of(F.lit(i)) for i in range(len(models.languages)))).alias("log_p"))


def _identified_by_tables(docs: DataFrame, models: Models, judged: Callable, schema: T.StructType) -> DataFrame:
    """The exact way for models that aren't broadcast: blocks of texts get the probabilities of their runs."""
    blocks = settle(docs.mapInArrow(_cut, "block string, rows binary, grams array<string>"), "blocks", _BLOCKS)
    pairs = blocks.select("block", F.explode("grams").alias("gram"))
    found = settle(run_probabilities(settle(pairs.select("gram").distinct(), "runs"), models), "runs")
    own = pairs.join(found, "gram").groupBy("block").agg(F.collect_list("gram").alias("grams"), F.flatten(F.collect_list("log_p")).alias("log_p"))
    n = len(models.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                grams, log_p = (batch.column(c)[i].values for c in ("grams", "log_p"))
                known = np.zeros(0, _U), np.zeros((0, n))
                if grams is not None and len(grams):
                    hashes = _gram_hashes(np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER))[ORDER]
                    order = np.argsort(hashes)
                    known = hashes[order], log_p.to_numpy().reshape(-1, n)[order]
                for rows in pa.ipc.open_stream(batch.column("rows")[i].as_py()):
                    yield judged(rows, known)

    return blocks.drop("grams").join(own, "block", "left").mapInArrow(run, schema)


def identify(docs: DataFrame, models: Models, least_score: float = 0.5, detail: bool = False) -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``cross_entropy``, ``n_signs`` and ``rejected``.

    ``lang_pred`` is the language with the lowest nats a sign, the first by name of equal
    ones; ``und`` with score 0 for null, empty and letterless texts, and where no language was
    learnt. ``score`` is the calibrated chance that it is right. ``rejected``: there is no
    language, the score is below ``least_score``, or the text needs more nats a sign than the
    language's limit allows a text of its length. Rows are independent, so repeated ones get
    equal results; other columns pass through, and ones named like the new ones are replaced.
    ``detail`` adds ``margin``: the nats by which the next language is worse.
    """
    ship(docs.sparkSession)
    new = ["lang_pred", "score", "cross_entropy", "n_signs", "rejected", *["margin"] * detail]
    docs = docs.drop(*new)
    schema = extended(docs.schema, "lang_pred string, score double, cross_entropy double, n_signs long, rejected boolean" + ", margin double" * detail)
    shared = docs.sparkSession.sparkContext.broadcast(replace(models, levels=[] if models.whole else models.levels, whole=()))

    def judged(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
        held = shared.value
        raw, offsets = X.utf8(batch.column("text"))
        parts = [_judged(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], held, known) for low, high in X.blocks(offsets, _BLOCK)]
        best, nats, size, margin = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
        none = best < 0
        score = np.where(none, 0.0, _sure(margin, held))
        names = pa.array([*held.languages, UNKNOWN], pa.string()).take(pa.array(np.where(none, len(held.languages), best)))
        rejected = none | (score < least_score)
        if held.limits:
            rejected |= (nats - np.array(held.means)[best]) * np.sqrt(size) > np.array(held.limits)[best]
        columns = [names, pa.array(score), pa.array(nats), pa.array(size.astype(np.int64)), pa.array(rejected), *[pa.array(margin)] * detail]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])

    if models.whole:
        return _identified_by_tables(docs, models, judged, schema)
    return docs.mapInArrow(lambda batches: (judged(batch) for batch in batches), schema)


def trained(docs: DataFrame, max_grams: int = 1 << 19) -> Models:
    """Models of all learnt rows, calibrated by rows that had been left aside of their counts."""
    most = _learnt(docs).select("lang", "text", _aside().alias("aside"))
    counts = settle(gram_counts(most.where("NOT aside")), "grams")
    first = calibrate(docs, _fitted(counts, max_grams))
    every = settle(counts.unionByName(gram_counts(most.where("aside"))).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    models = _fitted(every, max_grams)
    mean, limit = dict(zip(first.languages, first.means)), dict(zip(first.languages, first.limits))
    # a language whose rows are all aside has no limit
    return replace(models, slope=first.slope, offset=first.offset, means=tuple(mean.get(x, 0.0) for x in models.languages), limits=tuple(limit.get(x, float("inf")) for x in models.languages))


def identified_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    rows = docs.select("doc_id", "text", "lang")
    out = identify(rows.select("doc_id", "text"), trained(rows))
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), F.round("cross_entropy", 6).alias("cross_entropy"), "rejected")
