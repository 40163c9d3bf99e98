"""Directed relationship graphs: checks, bounded traversal and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_problems(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, problem): unknown ends, self loops and repeated keys of edges(source, target, kind, raw)."""
    known = nodes.select(F.col("id").alias("__id")).distinct()
    ends = [edges.join(known, F.col(c) == F.col("__id"), "left_anti").select("source", "target", F.lit(f"unknown_{c}").alias("problem")) for c in ("source", "target")]
    loops = edges.where("source = target").select("source", "target", F.lit("self_loop").alias("problem"))
    twice = edges.groupBy("source", "target", "kind", "raw").agg(F.count("*").alias("n")).where("n > 1").select("source", "target", F.lit("duplicate_edge").alias("problem"))
    return ends[0].union(ends[1]).union(loops).union(twice)


def traverse(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """(seed_set, source, target, kind, hop, path): first discovery of each node from a set of seeds.

    seeds(seed_set, id, pos). Seeds count as seen. In each hop a new node is found by the edge that
    comes first by its source's discovery order, then (target, kind, raw); the loop is over hops, at
    most two by default, never over nodes.
    """
    label = F.coalesce("kind", "raw")
    usable = edges.where(label.isin(kinds)) if kinds else edges
    usable = usable.select("source", "target", label.alias("kind"), "raw")
    start = F.expr("cast(array() as array<struct<source:string,target:string,kind:string>>)")
    front = seeds.select("seed_set", F.col("id").alias("node"), F.col("pos").alias("ord"), start.alias("path"))
    seen, found = front.select("seed_set", "node"), None
    for hop in range(1, max_hops + 1):
        step = front.join(usable, front["node"] == usable["source"]).select("seed_set", "source", "target", "kind", "raw", "ord", "path")
        step = step.join(seen.withColumnRenamed("node", "target"), ["seed_set", "target"], "left_anti")
        first = F.row_number().over(Window.partitionBy("seed_set", "target").orderBy("ord", "kind", "raw"))
        step = step.withColumn("r", first).where("r = 1")
        order = F.row_number().over(Window.partitionBy("seed_set").orderBy("ord", "target", "kind", "raw"))
        edge = F.struct(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("kind").cast("string").alias("kind"))
        step = step.select("seed_set", "source", "target", "kind", F.lit(hop).alias("hop"), F.concat("path", F.array(edge)).alias("path"), order.alias("next"))
        seen = seen.union(step.select("seed_set", F.col("target").alias("node")))
        front = step.select("seed_set", F.col("target").alias("node"), F.col("next").alias("ord"), "path")
        part = step.drop("next")
        found = part if found is None else found.union(part)
    return found
