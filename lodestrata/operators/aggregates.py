"""Summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.runtime import settle


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each share): exact quantiles with linear interpolation of the values of each group.

    Equal values of a group are counted before anything is sorted, so a row stands for each
    different value, however often it occurs. These rows are sorted over ranges of groups and
    values, so that a group of very many values is spread over tasks; only those of ranges
    that hold a wanted place are looked at again. Null values don't count, and groups without
    a name are left out.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("times_"))
    ranged = settle(rows.repartitionByRange(*by, "v_").withColumn("part_", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "part_").agg(F.sum("times_").alias("held_"))
    group = W.partitionBy(*by)
    placed = counts.withColumn("n", F.sum("held_").over(group)).withColumn("start_", F.sum("held_").over(group.orderBy("part_")) - F.col("held_"))
    wanted = placed.withColumn("q_", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in shares.items()))))
    place = (F.col("n") - 1) * F.col("q_.share")
    low, high = F.floor(place), F.ceil(place)
    ends = F.array(F.struct(low.alias("at"), (1 - (place - low)).alias("weight")), F.struct(high.alias("at"), (place - low).alias("weight")))
    wanted = wanted.withColumn("e_", F.explode(ends)).where("e_.weight > 0 AND e_.at >= start_ AND e_.at < start_ + held_")
    wanted = wanted.select(*by, "part_", "n", F.col("q_.name").alias("name_"), F.col("e_.weight").alias("weight_"), (F.col("e_.at") - F.col("start_") + 1).alias("at_"))
    behind = F.sum("times_").over(W.partitionBy(*by, "part_").orderBy("v_"))
    near = ranged.join(wanted.select(*by, "part_").distinct(), [*by, "part_"]).withColumn("last_", behind)
    met = wanted.join(near, [*by, "part_"]).where((F.col("at_") <= F.col("last_")) & (F.col("at_") > F.col("last_") - F.col("times_")))
    each = [F.sum(F.when(F.col("name_") == name, F.col("v_") * F.col("weight_"))).alias(name) for name in shares]
    return met.groupBy(*by).agg(F.max("n").alias("n"), *each)


def quantile_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, least, p25, median, p75, most, mean) of each group."""
    ends = df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return exact_quantiles(df, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).join(ends, by)


def compared(df: DataFrame, groups: Column, value: str) -> DataFrame:
    """The median and count of each group, and its difference from that over all rows of all groups in per cent.

    ``groups`` is an array: a row counts once for each group that it is in, overall as well.
    """
    rows = df.select(F.explode(groups).alias("grp"), F.col(value).alias("v"))
    told = exact_quantiles(rows, ["grp"], "v", {"median": 0.5})
    base = exact_quantiles(rows.withColumn("every", F.lit(0)), ["every"], "v", {"base": 0.5}).select("base")
    return told.join(F.broadcast(base)).select("grp", "n", "median", (100 * (F.col("median") - F.col("base")) / F.col("base")).alias("vs_overall_pct"))


def status_counts(df: DataFrame, status: str, states: list[str]) -> DataFrame:
    """A row for each state, 0 where no row has it."""
    counted = df.groupBy(status).agg(F.count("*").alias("n"))
    named = df.sparkSession.createDataFrame([(s,) for s in states], f"{status} string")
    return named.join(counted, status, "left").select(status, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def funnel(status: Column, age_days: Column, reached: dict[str, list[str]]) -> list[Column]:
    """count, rows of the last week, and for each step rows and per cent of all that reached it."""
    out = [F.count("*").alias("n"), F.count_if(age_days <= 7).alias("this_week")]
    for step, states in reached.items():
        n = F.count_if(status.isin(states))
        out += [n.alias(f"n_{step}"), F.coalesce(F.try_divide(100.0 * n, F.count("*")), F.lit(0.0)).alias(f"{step}_rate")]
    return out


def action_report(df: DataFrame, source: str, action: str, actions: list[str]) -> DataFrame:
    """Counts of actions for each source, and for all of them."""
    counts = [F.count_if(F.col(action) == a).alias(a) for a in actions]
    return df.rollup(source).agg(F.count("*").alias("fetched"), *counts).select(F.coalesce(source, F.lit("all")).alias(source), "fetched", *actions)


def completeness(columns: list[str]) -> Column:
    """The share of columns that hold something."""
    filled = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return total / float(len(columns))
