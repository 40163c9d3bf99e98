"""Connected components over an edge table, without collecting links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.joins import hot_join
from textquarry.session import discard, materialize

#: Most edges that one task may finish, in about two seconds and 100 MB.
LAST_EDGES = 1_000_000


def _smallest_reachable(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For positions 0.. of sorted ids and edges (u, v): the smallest position reachable. Union by the smaller root, with path halving."""
    root = list(range(len(ids)))
    for a, b in zip(u.tolist(), v.tolist()):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a < b:
            root[b] = a
        elif b < a:
            root[a] = b
    for i, r in enumerate(root):  # parents are smaller, so they are final before their children
        root[i] = root[r]
    return np.asarray(root, np.int64)


def _finish(edges: DataFrame) -> DataFrame:
    """(id, component) of an edge table of at most LAST_EDGES rows, in one task of an executor."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        u, v = (pd.concat([p[c] for p in parts], ignore_index=True) for c in ("u", "v"))
        codes, ids = pd.factorize(pd.concat([u, v], ignore_index=True), sort=True)
        ids = np.asarray(ids)
        root = _smallest_reachable(ids, codes[: len(u)], codes[len(u) :])
        for at in range(0, len(ids), 100_000):
            yield pd.DataFrame({"id": ids[at : at + 100_000], "component": ids[root[at : at + 100_000]]})

    return edges.select("u", "v").repartition(1).mapInPandas(run, T.StructType([T.StructField("id", kind), T.StructField("component", kind)]))


def _forest(edges: DataFrame) -> DataFrame:
    """(id, parent): every vertex points to its smallest neighbour; of two that point to each other the smaller is the root."""
    parent = materialize(edges.union(edges.select("v", "u")).toDF("id", "n").groupBy("id").agg(F.min("n").alias("parent")), "parent")
    up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
    turned = hot_join(parent, up, "parent")
    found = turned.select("id", F.when((F.col("grand") == F.col("id")) & (F.col("id") < F.col("parent")), F.col("id")).otherwise(F.col("parent")).alias("parent"))
    found = materialize(found, "forest")
    discard(parent)
    return found


def _roots(forest: DataFrame) -> DataFrame:
    """(id, parent) with every id pointing to the root of its tree: pointers are doubled until none moves, at most log2 of the depth times."""
    while True:
        up = forest.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        jumped = materialize(hot_join(forest, up, "parent").select("id", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "jump")
        discard(forest)
        forest = jumped.select("id", "parent")
        if jumped.where("moved").isEmpty():
            return jumped


def connected_components(links: DataFrame, a: str = "a", b: str = "b", last_edges: int = LAST_EDGES) -> DataFrame:
    """(id, component): every id that occurs in `links`, with the smallest id reachable from it.

    Null ends and self loops are ignored, repeated links count once; an empty table gives an empty
    result. Rounds of contraction: every vertex points to its smallest neighbour, which gives trees
    (two vertices can point to each other, longer cycles can't arise); trees shrink to their roots
    and edges between roots go on. Every vertex with an edge joins another one, so that the vertices
    at least halve each round, whatever the shape: long chains take a logarithm of their length.
    Once at most `last_edges` edges are left, one task finishes them by union-find; then the rounds'
    trees are walked back. Minima are combined before shuffles, joins deal out the hot ends of stars,
    and every round is a written table, so a lost executor costs one round at most.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    trees = []
    while edges.count() > last_edges:
        tree = _roots(_forest(edges))
        trees.append(tree)
        of = tree.select("id", F.col("parent").alias("r"))
        one = hot_join(edges, of.withColumnRenamed("id", "u"), "u").select(F.col("r").alias("ru"), "v")
        both = hot_join(one, of.withColumnRenamed("id", "v"), "v").select("ru", F.col("r").alias("rv")).where("ru <> rv")
        left = materialize(both.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        discard(edges)
        edges = left
        if edges.isEmpty():
            break
    labels = materialize(_finish(edges), "labels")
    for tree in reversed(trees):  # a root without edges left has no label yet: its tree is a component, whose smallest id may not be the root
        joined = hot_join(tree.select("id", F.col("parent").alias("r")), labels.select(F.col("id").alias("r"), "component"), "r", "left")
        named = joined.select("id", F.coalesce("component", "r").alias("component"))
        labels = materialize(named, "labels")
        discard(tree)
    if not trees:
        return labels
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return materialize(hot_join(labels, least, "component").select("id", F.col("least").alias("component")), "labels")
