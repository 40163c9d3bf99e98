"""Skylines of many points: each task's own, then cells of a grid against the cells that may hold something better."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import materialize


def dominated_by(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x have a row of y that is no worse anywhere and better somewhere. Comparisons with NaN are false."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(y), 256):
        part = y[None, at : at + 256]
        left = np.flatnonzero(~out)
        a = x[left, None]
        out[left] = ((part >= a).all(2) & (part > a).any(2)).any(1)
    return out


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)  # nulls are NaN


def local_front(df: DataFrame, columns: list[str], kept: list[str], most: int = 4096) -> DataFrame:
    """df without rows that others of their task dominate, as far as a window of `most` good rows tells; none of the front is lost."""
    chosen = df.select(*kept, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = np.zeros((0, len(columns)))
        for batch in batches:
            x = _numbers(batch, columns)
            stay = np.flatnonzero(~dominated_by(x, window))
            stay = stay[~dominated_by(x[stay], x[stay])]
            window = np.concatenate([window, x[stay]])
            if len(window) > most:  # those with the largest sums of ranks rule most out
                best = np.argsort(-np.argsort(np.argsort(window, 0), 0).sum(1), kind="stable")[:most]
                window = window[best]
            yield batch.take(pa.array(stay))

    return chosen.mapInArrow(run, chosen.schema)


def grid_front(df: DataFrame, columns: list[str], kept: list[str], cells: int, block: int) -> DataFrame:
    """`kept` of the rows of a written table that no other row dominates. A row that lacks a number is no worse and no better than any other, so it stays."""
    whole = " and ".join(f"{c} is not null and not isnan({c})" for c in columns)
    lacking, rows = df.where(f"not ({whole})").select(*kept), df.where(whole)
    d = len(columns)
    g = max(2, int(cells ** (1 / d)))
    cuts = rows.approxQuantile(columns, [i / g for i in range(1, g)], 0.01)

    def place(column: str, some: list[float]):
        return F.size(F.filter(F.array(*[F.lit(v) for v in sorted({*some})]), lambda x: x <= F.col(column))) if some else F.lit(0)

    placed = rows.withColumn("cell", F.array(*map(place, columns, cuts)))
    counts = placed.groupBy("cell").agg(F.count("*").alias("n")).collect()  # at most `cells` rows
    if not counts:
        return lacking
    where = np.array([r["cell"] for r in counts]).reshape(len(counts), d)
    alive = [i for i, w in enumerate(where) if not (where > w).all(1).any()]
    near = [(where[i].tolist(), where[j].tolist()) for i in alive for j in alive if (where[j] >= where[i]).all()]
    spark = df.sparkSession
    split = spark.createDataFrame([(r["cell"], -(-r["n"] // block)) for r in (counts[i] for i in alive)], "cell array<int>, blocks int")
    numbered = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = split.select("cell", numbered.alias("block"))
    met = spark.createDataFrame(near, "cell array<int>, other array<int>").join(each, "cell").join(each.toDF("other", "other_block"), "other")
    cut = placed.join(F.broadcast(split), "cell").withColumn("row", F.monotonically_increasing_id())  # at most `cells` rows; others are dominated as a whole
    cut = materialize(cut.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "cells")
    pair = ["cell", "block", "other", "other_block"]
    mine = cut.join(met, ["cell", "block"]).select(*pair, "row", *columns)
    theirs = cut.select(F.col("cell").alias("other"), F.col("block").alias("other_block"), *[F.col(c).alias(f"{c}o") for c in columns])
    others = theirs.join(met, ["other", "other_block"]).select(*[F.col(k).alias(f"{k}o") for k in pair], *[f"{c}o" for c in columns])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": a["row"][dominated_by(a[columns].to_numpy(np.float64), b[[f"{c}o" for c in columns]].to_numpy(np.float64))]})

    worse = mine.groupBy(*pair).cogroup(others.groupBy(*[f"{k}o" for k in pair])).applyInPandas(compare, "row long").distinct()
    return cut.join(worse, "row", "left_anti").select(*kept).unionByName(lacking)
