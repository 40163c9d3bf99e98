"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import materialize


def nearest(fraction: float) -> Callable[[Column], Column]:
    """Index round((n - 1) * fraction) of n sorted values, halves to even."""
    return lambda n: F.bround((n - 1) * F.lit(fraction)).cast("long")


def floored(fraction: float) -> Callable[[Column], Column]:
    """Index int(n * fraction) of n sorted values, the last at most."""
    return lambda n: F.least(F.floor(n * F.lit(fraction)), n - 1).cast("long")


def exact_ranks(df: DataFrame, keys: list[str], value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and, for each pick, the value at its index among the group's sorted values that aren't null.

    Values are counted first, so that repeated ones are one row, and dealt out by ranges of group
    and value, so that a large group takes many tasks. The counts of the ranges (a row for a group
    and range) tell which of them holds an index, and only that one is looked at by rows. Groups
    with nulls alone have no row; null keys are a group.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("__v")).where("__v is not null")
    each = rows.groupBy(*names, "__v").agg(F.count("*").alias("__c"))
    ranged = materialize(each.repartitionByRange(*names, "__v").withColumn("__r", F.spark_partition_id()), "ranges")  # ranges are drawn once
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    totals = ranged.groupBy(*names, "__r").agg(F.sum("__c").alias("__m"))
    running = F.sum("__m").over(group.orderBy("__r"))
    totals = totals.select(*names, "__r", "__m", (running - F.col("__m")).alias("__before"), F.sum("__m").over(group).alias("n"))
    asked = totals.select(*names, "__r", "__m", "__before", "n", F.inline(F.array(*[F.struct(F.lit(name).alias("__pick"), at(F.col("n")).alias("__at")) for name, at in picks.items()])))
    asked = asked.where((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__m")))
    here = asked.groupBy(*names, "__r").agg(F.collect_list(F.struct("__pick", F.expr("__at - __before").alias("at"))).alias("__asked"), F.first("n").alias("n"))
    here = here.withColumnsRenamed({k: f"{k}_" for k in (*names, "__r")})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names]
    met = ranged.join(here, [*same, F.col("__r") == F.col("__r_")]).select(*names, "__r", "__v", "__c", "__asked", "n")
    upto = F.sum("__c").over(Window.partitionBy(*names, "__r").orderBy("__v"))
    found = met.withColumn("__upto", upto).select(*names, "__v", "__c", "__upto", "n", F.inline("__asked")).where("at >= __upto - __c and at < __upto")
    out = found.groupBy(*names).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__pick") == name, F.col("__v"))).alias(name) for name in picks])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", *picks)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in one order over the whole table.

    Rows are sorted by ranges, each numbers its own, and the counts of earlier ranges (a row a
    range) are added. The order should have no ties, as tied rows may take either's place.
    """
    sorted_ = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = sorted_.withColumn("__r", F.shiftright("__at", 33)).withColumn("__i", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__r").agg(F.count("*").alias("__n"))
    before = counts.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__before"))  # a row a range
    return placed.join(F.broadcast(before), "__r").select(*df.columns, (F.col("__before") + F.col("__i") + 1).alias(name))
