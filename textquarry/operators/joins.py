"""Joins whose hot keys don't land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of the left rows is hot; so there are at most so many hot keys, and their right rows are broadcast.
HOT_PARTS = 200


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left join right on `key`, whose values are unique in `right`; how: inner or left.

    Rows of hot keys stay where they are and meet the at most HOT_PARTS right rows of such keys by
    broadcast; all others meet by a shuffle. `left` is read three times or four, so it should be a
    written table or cheap. Null keys match nothing and aren't dealt out. Columns other than the key
    must not clash.
    """
    names = [c for c in right.columns if c != key]
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = left.select(F.count("*").alias("__all"))
    least = F.greatest(F.col("__all") / HOT_PARTS, F.lit(1000))
    hot = F.broadcast(counts.join(F.broadcast(total), F.col("__n") > least).select(key, F.lit(True).alias("__hot")))
    marked = left.join(hot, key, "left")
    rows = F.broadcast(right.join(hot, key).select(key, *names))
    here = marked.where("__hot").drop("__hot").join(rows, key, how)
    there = marked.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot").join(right, key, how)
    out = [*left.columns, *names]
    found = here.select(*out).unionByName(there.select(*out))
    if how == "left":
        found = found.unionByName(left.where(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in names]))
    return found
