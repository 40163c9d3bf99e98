"""Batch analytics: censuses, comparisons, gates, Pareto fronts, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators import resampling, skyline
from textquarry.session import materialize


def census(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n): counts of each value; a missing one is `missing`. Array values count each element."""
    out = None
    for name, col in dimensions.items():
        one = df.select(F.coalesce(col.cast("string"), F.lit("missing")).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
        out = one if out is None else out.union(one)
    return out


def transitions(base: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """(transition, n): `a->b` of each key that both have; a key that one lacks is `missing`."""
    a, b = base.select(key, F.col(value).cast("string").alias("a")), candidate.select(key, F.col(value).cast("string").alias("b"))
    joined = a.join(b, key, "full")
    m = F.lit("missing")
    return joined.groupBy(F.concat_ws("->", F.coalesce("a", m), F.coalesce("b", m)).alias("transition")).agg(F.count("*").alias("n"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `violations`, the names of the rules that hold, and `ready`."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).withColumn("ready", F.size("violations") == 0)


def pareto(df: DataFrame, id_col: str, objectives: dict[str, str]) -> DataFrame:
    """df with `dominated`. objectives: column -> max or min. A candidate dominates if it is no worse in all and better in one.

    Equal objective vectors stand for all their rows.
    """
    cols = [*objectives]
    good = [(F.col(c) if d == "max" else -F.col(c)).alias(f"__o{i}") for i, (c, d) in enumerate(objectives.items())]
    names = [f"__o{i}" for i in range(len(cols))]
    vectors = df.select(*good).distinct()
    state = _dominated_pairs(vectors, *names) if len(names) == 2 else _dominated(vectors, names)
    return df.select("*", *good).join(state, names).drop(*names)


def _dominated_pairs(vectors: DataFrame, a: str, b: str, ranges: int = 200) -> DataFrame:
    """A point is dominated if a better a has as good a b, or an equal a a better b.

    The best b of all better a is a running maximum, taken in two steps: over a fixed number of
    ranges of a, and within each range.
    """
    best = vectors.groupBy(a).agg(F.max(b).alias("top"))
    cuts = sorted({*best.select(F.col(a).cast("double").alias(a)).where(f"{a} is not null").approxQuantile(a, [i / ranges for i in range(1, ranges)], 0.001)}) if not best.isEmpty() else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(a))) if cuts else F.lit(0)
    placed = best.withColumn("part", part)
    tops = placed.groupBy("part").agg(F.max("top").alias("best"))
    later = tops.select("part", F.max("best").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("beyond"))  # at most `ranges` rows
    within = F.max("top").over(Window.partitionBy("part").orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1))
    ahead = placed.withColumn("within", within).join(F.broadcast(later), "part").select(a, "top", F.greatest("within", "beyond").alias("ahead"))
    return vectors.join(ahead, a).select(a, b, ((F.col(b) < F.col("top")) | F.coalesce(F.col("ahead") >= F.col(b), F.lit(False))).alias("dominated"))


def _dominated(vectors: DataFrame, names: list[str], strong: int = 500, cells: int = 4096, block: int = 2048) -> DataFrame:
    """Three objectives or more: skylines of parts, merged by cells of a grid.

    What a fixed number of strong vectors dominate goes first, then what each task finds dominated
    among its own rows. The rest falls into cells between quantiles of the objectives, at most
    `cells`. A cell with another above it in every objective is dominated as a whole; any other meets
    the cells that are nowhere below it, block by block, so that no task holds more than two blocks
    and cells that can't dominate each other never meet. A vector that lacks a number, or has NaN,
    neither dominates nor is dominated.
    """
    other = [F.col(n).alias(f"{n}b") for n in names]
    no_worse = better = None
    for n in names:
        ge, gt = F.col(f"{n}b") >= F.col(n), F.col(f"{n}b") > F.col(n)
        no_worse = ge if no_worse is None else no_worse & ge
        better = gt if better is None else better | gt
    ends = vectors.agg(*[x for n in names for x in (F.min(n).alias(f"{n}l"), F.max(n).alias(f"{n}h"))])
    share = sum((F.coalesce((F.col(n) - F.col(f"{n}l")) / F.nullif(F.col(f"{n}h") - F.col(f"{n}l"), F.lit(0)), F.lit(0.0)) for n in names), F.lit(0.0))
    numbers = " and ".join(f"not isnan(cast({n} as double))" for n in names)
    top = vectors.where(numbers).crossJoin(F.broadcast(ends)).orderBy(share.desc()).limit(strong).select(*other)  # one row beside each
    left = vectors.join(F.broadcast(top), no_worse & better, "left_anti")
    number = left.select(*names, F.struct(*names).alias("__row"), *[F.col(n).cast("double").alias(f"{n}d") for n in names])
    own = materialize(skyline.local_front(number, [f"{n}d" for n in names], names), "front")
    front = skyline.grid_front(own, [f"{n}d" for n in names], names, cells, block).withColumn("__front", F.lit(True))
    same = None
    for n in names:
        eq = F.col(n).eqNullSafe(F.col(f"{n}f"))
        same = eq if same is None else same & eq
    marked = vectors.join(front.withColumnsRenamed({n: f"{n}f" for n in names}), same, "left")
    return marked.select(*names, F.col("__front").isNull().alias("dominated"))


def lexicographic_best(df: DataFrame, objectives: dict[str, str], id_col: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) if d == "max" else F.asc(c) for c, d in objectives.items()], id_col).limit(1)


def hit_list_differences(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(query_id, same_ids, same_scores, max_delta) of rank-aligned lists."""
    a, b = actual.select("query_id", "rank", F.col("chunk_id").alias("ca"), F.col("score").alias("sa")), expected.select("query_id", "rank", F.col("chunk_id").alias("cb"), F.col("score").alias("sb"))
    j = a.join(b, ["query_id", "rank"], "full")
    delta = F.coalesce(F.abs(F.col("sa") - F.col("sb")), F.lit(float("inf")))
    return j.groupBy("query_id").agg(F.every(F.col("ca").eqNullSafe(F.col("cb"))).alias("same_ids"), F.every(delta <= tolerance).alias("same_scores"), F.max(delta).alias("max_delta"))


def pool_churn(shallow: DataFrame, deep: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, overlap, jaccard, entrants, displaced) of two top-k lists."""
    top = lambda d, n: d.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias(n))
    j = top(shallow, "a").join(top(deep, "b"), ["query_id", "chunk_id"], "full").na.fill(0, ["a", "b"])
    g = j.groupBy("query_id").agg(F.sum(F.col("a") * F.col("b")).alias("overlap"), F.count("*").alias("u"), F.sum(F.col("b") * (1 - F.col("a"))).alias("entrants"), F.sum(F.col("a") * (1 - F.col("b"))).alias("displaced"))
    return g.select("query_id", "overlap", (F.col("overlap") / F.col("u")).alias("jaccard"), "entrants", "displaced")


def bootstrap_interval(df: DataFrame, group: str, order: str, value: str, resamples: int = 1000, seed: int = 2026) -> DataFrame:
    """(group, n, mean, median, low, high): percentile interval of the mean of paired deltas, in the order of `order`, by a seeded generator.

    The resamples are those of numpy's default generator with the seed, dealt out over tasks
    (operators/resampling.py). A metric's deltas are one number a case of an evaluation set; each task
    holds those of one group.
    """
    deltas = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("d"))
    packed = materialize(deltas.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]).alias("d")).withColumn("n", F.size("d").cast("long")), "deltas")
    kind = df.schema[group].dataType.simpleString()

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"g": pdf["g"], "n": pdf["n"], "mean": [np.mean(d) for d in pdf["d"]], "median": [np.median(d) for d in pdf["d"]]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:  # a number for each resample
        low, high = np.percentile(pdf["mean"], [2.5, 97.5])
        return pd.DataFrame({"h": pdf["g"].iloc[:1], "low": [low], "high": [high]})

    means = resampling.resampled_means(packed, "g", "d", resamples, seed)
    interval = means.groupBy("g").applyInPandas(ends, f"h {kind}, low double, high double")
    out = packed.mapInPandas(summary, f"g {kind}, n long, mean double, median double").join(interval, F.col("g").eqNullSafe(F.col("h")))
    return out.select(F.col("g").alias(group), "n", "mean", "median", "low", "high")


def win_tie_loss(df: DataFrame, a: str, b: str, tolerance: float = 1e-6) -> DataFrame:
    d = F.col(b) - F.col(a)
    return df.agg(F.count_if(d > tolerance).alias("win"), F.count_if(F.abs(d) <= tolerance).alias("tie"), F.count_if(d < -tolerance).alias("loss"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"))


def floor_percentile(values: Column, fraction: float) -> Column:
    """The value at index int(n * fraction) of an array, the last at most."""
    s = F.array_sort(values)
    return F.element_at(s, (F.least(F.floor(F.size(s) * F.lit(fraction)), F.size(s) - 1) + 1).cast("int"))


def smallest_covering_cap(df: DataFrame, length: str, caps: list[int]) -> DataFrame:
    """One row: how many rows exceed each cap, and the smallest cap that none exceeds."""
    m = F.max(length)
    cap = F.array_min(F.filter(F.array(*[F.lit(c) for c in caps]), lambda c: c >= F.col("__m")))
    return df.agg(m.alias("__m"), *[F.count_if(F.col(length) > c).alias(f"over_{c}") for c in caps]).withColumn("cap", cap).withColumnRenamed("__m", "longest")


def decision_gate(row: DataFrame, hard: Column, reliable: Column, delta: Column, band: float) -> DataFrame:
    """Adds `decision`: reject on a protocol fault, then on reliability, then by the band of the mean delta."""
    return row.withColumn("decision", F.when(~hard, F.lit("reject_protocol")).when(~reliable, F.lit("reject_reliability")).when(delta > band, F.lit("accept")).when(delta < -band, F.lit("reject_quality")).otherwise(F.lit("neutral")))
