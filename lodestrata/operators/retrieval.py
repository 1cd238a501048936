"""Keyword, vector and hybrid search, reranking and context budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.counting import frequencies
from lodestrata.functions.text import tokens
from lodestrata.runtime import settle, ship

K1, B = 1.5, 0.75
#: Decimal places that scores are rounded to before they order rows, so that float noise decides no tie.
PLACES = 6


def bm25_gain(n: Column, df: Column, tf: Column, length: Column, mean: Column, times: int) -> Column:
    """What a token with frequency ``tf`` adds to the score of a document, ``times`` being its repeats in the query."""
    return times * F.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the documents that hold a query token.

    N and the mean length count all rows given, so a filter belongs in front. A token that
    the query repeats counts as often. The texts are read once: what is kept of each is its
    number of tokens and how often it has those of the query. ``sources.keyword_index`` has
    the same scores for corpora that are searched again and again.
    """
    spark = docs.sparkSession
    wanted = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    terms = {r["term"]: r["times"] for r in wanted.collect()}  # as many rows as the query has words
    counted = frequencies(docs.select(key, F.col(text).alias("text_")), list(terms), "text_")
    sized = settle(counted.select(key, "length", *(F.get("tf", F.lit(i)).alias(f"tf{i}") for i in range(len(terms)))), "term-counts")
    stats = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score, held = F.lit(0.0), F.lit(False)
    for i, times in enumerate(terms.values()):
        tf = F.col(f"tf{i}")
        score = score + F.when(tf > 0, bm25_gain(F.lit(stats["n"]), F.lit(stats[f"df{i}"]), tf, F.col("length"), F.lit(stats["mean"] or 1.0), times)).otherwise(0.0)
        held = held | (tf > 0)
    return sized.where(held).select(key, F.round(score, PLACES).alias("score"))


def top_terms(text: str | Column, n: int, stop: list[str]) -> Column:
    """The n most frequent tokens of a text, as (n, term): two characters at least, no numbers, no stop words.

    Each text is counted by itself: its tokens are sorted, and runs of equal ones measured.
    """
    kept = F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.isin(stop))

    def ranked(found: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: (i == 1) | (F.get(found, i - 1) != F.get(found, i - 2)))
        return _once(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(found) + 1)), lambda a, b: F.struct((a - b).alias("less"), F.get(found, a - 1).alias("term"))))

    counted = _once(F.array_sort(kept), lambda found: F.when(F.size(found) > 0, ranked(found)))
    return F.transform(F.slice(F.array_sort(counted), 1, n), lambda c: F.struct((-c["less"]).cast("long").alias("n"), c["term"].alias("term")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value more than once, with the value evaluated once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Pairs of an item and a word that are broadcast at once.
SHARED_PAIRS = 1 << 20


def most_shared(docs: DataFrame, items: DataFrame, k: int, pairs: int | None = None) -> DataFrame:
    """(item_id, doc_id, shared): for each item the k documents that share most of its words.

    Words stand between white space, in small letters. A task keeps k documents of each
    item, so no pair but those leaves it. The items' words are broadcast as (word, items),
    ``SHARED_PAIRS`` pairs at once or one item; with more of them the documents are read
    again for the next block, one block after the other. Smaller ids come first among
    equals. Items of one id are one item.
    """
    spark = docs.sparkSession
    ship(spark)
    words = F.array_distinct(F.split(F.trim(F.lower("text")), r"\s+"))
    asked = settle(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("word")).distinct(), "item-words")
    passes = max(1, -(-asked.count() // (pairs or SHARED_PAIRS)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    best: DataFrame | None = None
    order = W.partitionBy("item_id").orderBy(F.col("shared").desc(), "doc_id")
    for number in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).groupBy("word").agg(F.collect_list("item_id").alias("items")).toArrow()
        shared = spark.sparkContext.broadcast(part)
        found = rows.mapInArrow(lambda batches, shared=shared: _best_of_task(batches, shared.value, k), "item_id long, doc_id long, shared long")
        own = found.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k).drop("rank_")
        if passes > 1:  # so that the block's words can be let go
            own = settle(own, "shared-words")
            shared.destroy()
        best = own if best is None else best.unionByName(own)
    return best


def _best_of_task(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of this task for each item; what a document shares is counted over its own words' items only."""
    place = {w: i for i, w in enumerate(asked.column("word").to_pylist())}
    lists = asked.column("items").combine_chunks()
    cuts, flat = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
    ids, item = np.unique(flat, return_inverse=True)
    best: dict[int, list[tuple[int, int]]] = {}
    least = np.ones(len(ids), np.int64)  # what a document has to reach
    for batch in batches:
        for doc, words in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist()):
            known = [place[w] for w in words or () if w in place]
            if not known:
                continue
            which, counts = np.unique(np.concatenate([item[cuts[p] : cuts[p + 1]] for p in known]), return_counts=True)
            good = counts >= least[which]
            for n, shared in zip(which[good].tolist(), counts[good].tolist()):
                best[n] = sorted([*best.get(n, []), (-shared, doc)])[:k]
                if len(best[n]) == k:
                    least[n] = -best[n][-1][0]
    rows = [(int(ids[n]), doc, -less) for n, found in best.items() for less, doc in found]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], ["item_id", "doc_id", "shared"])


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows; the smaller key comes first among equals."""
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different length, or of length zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def vector_search(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The exact k nearest vectors by cosine: one pass, k rows from each task."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(key, F.round(cosine(F.col(vector), literal), PLACES).alias("score"))
    return top(scored, "score", key, k)


def max_normalised(df: DataFrame, score: str) -> DataFrame:
    """Positive scores divided by the largest one."""
    most = df.agg(F.max(score).alias("most")).first()["most"]
    return df.where(F.col(score) > 0).withColumn(score, F.col(score) / F.lit(most))


def fused(vectors: DataFrame, keywords: DataFrame, key: str, alpha: float = 0.7) -> DataFrame:
    """(key, vector_score, bm25_score, score): a full outer join of two candidate lists.

    A missing side counts as 0; the vector score is shifted from -1..1 to 0..1.
    """
    a = vectors.select(key, F.col("score").alias("vector_score"))
    b = keywords.select(key, F.col("score").alias("bm25_score"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"))
    return both.withColumn("score", F.round(alpha * (F.col("vector_score") + 1) / 2 + (1 - alpha) * F.col("bm25_score"), PLACES))


def boosted(hits: DataFrame, query: str, title: str, keywords: str) -> DataFrame:
    """score raised by 0.05 for a word in the title, and 0.01 for each keyword, 0.05 at most."""
    words = F.array_distinct(tokens(F.lit(query)))
    in_title = F.when(F.arrays_overlap(tokens(title), words), 0.05).otherwise(0.0)
    in_keywords = F.least(F.lit(0.05), 0.01 * F.size(F.array_intersect(tokens(keywords), words)))
    return hits.withColumn("score", F.round(F.col("score") + in_title + in_keywords, PLACES))


def min_max(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Scores scaled to 0..1 within groups; a constant positive series becomes 1, another 0."""
    ends = df.groupBy(*by).agg(F.min(score).alias("low_"), F.max(score).alias("high_"))
    low, high = F.col("low_"), F.col("high_")
    scaled = F.when(high > low, (F.col(score) - low) / (high - low)).when(F.col(score) > 0, 1.0).otherwise(0.0)
    return df.join(ends, by).withColumn(score, scaled).drop("low_", "high_")


def packed(hits: DataFrame, budget: int, by: list[str], cost: Column, order: list[Column], least: int = 32) -> DataFrame:
    """The hits of each group that fit a budget, with ``used`` tokens each.

    Costs are at least 1 and add up in order. The first hit that doesn't fit gets what is
    left if that is ``least`` or more; nothing behind it is tried.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = hits.withColumn("cost_", F.greatest(F.lit(1), cost)).withColumn("end_", F.sum("cost_").over(w)).withColumn("start_", F.col("end_") - F.col("cost_"))
    over = F.count_if(F.col("end_") > budget).over(w)
    kept = summed.withColumn("over_", over).where((F.col("end_") <= budget) | ((F.col("over_") == 1) & (F.col("end_") > budget) & (budget - F.col("start_") >= least)))
    return kept.withColumn("used", F.least(F.col("cost_"), budget - F.col("start_"))).withColumn("truncated", F.col("end_") > budget).drop("cost_", "end_", "start_", "over_")
