"""Bootstrap resamples of numpy's default generator, dealt out over tasks.

The generator (PCG64) can jump ahead, so that any task can start anywhere in its stream of 32-bit
words. A word becomes a case by Lemire's multiplication, and a few words are rejected, whatever
stands before them: a first pass counts the accepted words of each stretch of the stream, whose
running sums then tell where a resample starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the stream that a task looks at in one go; 8 MB.
STRETCH = 1 << 21
#: Tasks that the resamples of one group are dealt to; each is sent the group's values once.
DEALT = 16


def accepted(seed: int, at: int, words: int, n: int) -> np.ndarray:
    """The cases (0 to n - 1) that the words at, at + 1, ... of the stream give; rejected words give none. `at` is even."""
    stream = np.random.PCG64(seed).advance(at // 2)
    raw = stream.random_raw(-(-words // 2)).view(np.uint32)[:words].astype(np.uint64)  # the lower half of each number comes first
    scaled = raw * np.uint64(n)
    return (scaled >> np.uint64(32))[(scaled & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)].astype(np.int64)


def resampled_means(packed: DataFrame, group: str, values: str, resamples: int, seed: int) -> DataFrame:
    """(group, r, mean) of the resamples r of each group's array of values, as numpy draws them: integers(0, n, (resamples, n)).

    A group has at most 2**32 - 1 values. Resamples are dealt out in runs of about a stretch's words, to `DEALT` tasks a group,
    so that what is shuffled grows with the values alone, not with values and resamples.
    """
    kind = packed.schema[group].dataType
    n = F.size(values).cast("long")
    # the share of rejected words is below n / 2**32; what little may lack is drawn by a second look further on
    stretches = F.ceil((n * resamples) * (1 + n / float(1 << 32)) / STRETCH) + 1
    parts = packed.where(n > 1).select(group, n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), stretches.cast("long"))).alias("stretch"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [len(accepted(seed, s * STRETCH, STRETCH, k)) for k, s in zip(pdf["n"].tolist(), pdf["stretch"].tolist())]
            yield pd.DataFrame({"group": pdf[group], "stretch": pdf["stretch"], "accepted": found})

    counted = parts.repartition(F.col("stretch")).mapInPandas(count, T.StructType([T.StructField("group", kind), T.StructField("stretch", T.LongType()), T.StructField("accepted", T.LongType())]))
    per = counted.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("stretch", "accepted"))).alias("counts"))  # a number for two million draws
    each = F.greatest(F.lit(1), F.floor(F.lit(STRETCH) / n)).cast("int")
    runs = packed.select(F.col(group).alias("g"), F.col(values).alias("d"), n.alias("n"), each.alias("each")).join(per.select("group", F.transform("counts", lambda x: x["accepted"]).alias("counts")), F.col("g").eqNullSafe(F.col("group")), "left")
    runs = runs.select("g", "d", "n", "each", "counts", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("dealt")).repartition("g", "dealt")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, d, k, each, counts, dealt in zip(pdf["g"], pdf["d"], pdf["n"].tolist(), pdf["each"].tolist(), pdf["counts"], pdf["dealt"].tolist()):
                d = np.asarray(d, np.float64)
                before = None if k == 1 else np.r_[0, np.cumsum(counts)]
                for first in range(dealt * each, resamples, DEALT * each):
                    last = min(first + each, resamples)
                    means = np.repeat(d[0], last - first) if k == 1 else drawn(d, k, before, first, last)
                    yield pd.DataFrame({"g": pd.Series([g] * len(means), dtype=pdf["g"].dtype), "r": np.arange(first, last), "mean": means})

    def drawn(d: np.ndarray, k: int, before: np.ndarray, first: int, last: int) -> np.ndarray:
        s = int(np.searchsorted(before, first * k, "right")) - 1
        skip, got = first * k - int(before[s]), []
        while sum(map(len, got)) < (last - first) * k + skip:
            got.append(accepted(seed, s * STRETCH, STRETCH, k))
            s += 1
        return d[np.concatenate(got)[skip : skip + (last - first) * k].reshape(last - first, k)].mean(1)

    return runs.mapInPandas(draw, T.StructType([T.StructField("g", kind), T.StructField("r", T.LongType()), T.StructField("mean", T.DoubleType())])).withColumnRenamed("g", group)
