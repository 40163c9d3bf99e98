"""Components against union-find, joins with hot keys, scratch tables."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators.components import connected_components
from textquarry.operators.joins import hot_join
from textquarry.session import clear_scratch, discard, mark, materialize, scratch_dir, sweep


def union_find(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("last", [1_000_000, 0])
def test_components_of_a_long_chain(spark, last):
    ids = random.Random(1).sample(range(10**9), 10_000 if last else 2_000)
    got = connected_components(spark.createDataFrame([*zip(ids, ids[1:])], "a long, b long"), last_edges=last)
    assert {(r.id, r.component) for r in got.collect()} == {(i, min(ids)) for i in ids}


@pytest.mark.parametrize("last", [1_000_000, 300, 0])
def test_components_of_odd_graphs(spark, last):
    rng = random.Random(2)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(10**6, 2000 + i) for i in range(1200)] + [(5000 + i, 5000) for i in range(300)]
    links += [(None, 1), (2, None), (7, 7), (123456, 123456), *[(1, 2)] * 5]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), last_edges=last)
    assert {r.id: r.component for r in got.collect()} == union_find(links) and got.count() == len(union_find(links))
    names = [("a", "b"), ("c", "b"), ("x", "y"), (None, "q"), ("z", "z")]
    got = connected_components(spark.createDataFrame(names, "l string, r string"), "l", "r", last_edges=last).collect()
    assert {r.id: r.component for r in got} == union_find(names)
    assert connected_components(spark.createDataFrame([], "a long, b long"), last_edges=last).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join(spark, how):
    left = [(k, i) for i, k in enumerate([1] * 2500 + [2] * 1200 + [*range(3, 60)] * 3 + [None] * 40 + [777] * 1100)]
    right = [(k, f"v{k}") for k in range(1, 50)] + [(None, "never"), (900, "alone")]
    a, b = spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(right, "k int, v string")
    want = sorted(map(tuple, a.join(b, "k", how).select("k", "i", "v").collect()), key=repr)
    assert sorted(map(tuple, hot_join(a, b, "k", how).select("k", "i", "v").collect()), key=repr) == want
    assert hot_join(a.limit(0), b, "k", how).count() == 0


def test_scratch_tables_go(spark):
    import os

    df = materialize(spark.range(10).select("id", F.lit("x").alias("t")), "kept")
    folder = scratch_dir(spark).removeprefix("file://") + "/textquarry"
    other = materialize(spark.range(3), "gone")
    discard(other, spark.range(1))
    at = mark()
    kept, swept = materialize(spark.range(4), "stays"), materialize(spark.range(5), "swept")
    sweep(spark, at, kept)
    assert df.count() == 10 and kept.count() == 4 and [x for x in os.listdir(folder) if x.startswith(("gone", "swept"))] == [] and swept is not kept
    clear_scratch(spark)
    assert not os.path.exists(folder)
