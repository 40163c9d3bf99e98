"""Components of texts whose candidates come as groups around centres, without a group in one task.

Groups are cut into blocks, and the centre is in each of them. Within a block the candidates of an
index of points (sketches, count vectors) are verified on their full shingle sets, unless links
found before already join them; a block gives at most one link a member. Groups of several blocks
whose members are not all joined are compared across blocks: members outside the group's main
component against every block. So every two members are compared or already joined, no group is
held in one task, and no table of all pairs is made. The members that stay outside are met with the
whole group, which is quadratic where few of a large group link at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.components import connected_components
from textquarry.operators.joins import hot_join
from textquarry.session import discard, materialize

#: Ways that the rows of a bucket are dealt out when they meet the bucket's centre.
SALTS = 8
#: Bits of the filter that keeps texts of no group from being shuffled: 8 MB, whatever the number of texts.
FILTER_BITS = 1 << 26


def centred(buckets: DataFrame) -> DataFrame:
    """(centre, rep) of (key, rep): the members of every key of two or more, under the key's smallest member."""
    centres = buckets.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("m")).where("m > 1")
    dealt = centres.select("key", "centre", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = buckets.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["key", "salt"]).select("centre", "rep").distinct()


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose id is among `ids`, and some others: the ids' hashes in a bitmap of fixed size are sent to all tasks, so that nothing is shuffled."""
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    bits = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    met = df.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("__bucket"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("__bucket", "__bits")


def linker(candidates: Callable, shingles: Callable, percent: int) -> Callable:
    """For a block: rows (id, th, comp, probe, text, ...) -> links (a, b).

    candidates(rows, probe) gives positions (i, j) of pairs that may reach the threshold, likely ones
    first; pairs of one comp are joined already; shingles(text) is a sorted distinct array.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "th"]).sort_values(["id", "th"])
        ids, n = pdf["id"].tolist(), len(pdf)
        if n < 2:
            return pd.DataFrame({"a": pdf["id"][:0], "b": pdf["id"][:0]})
        i, j = candidates(pdf, pdf["probe"].to_numpy(bool))
        root, seen = [*range(n)], {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, c in enumerate(pdf["comp"].tolist()):
            root[find(x)] = find(seen.setdefault(c, x))
        texts, sets, links = pdf["text"].tolist(), {}, []
        for x, y in zip(i.tolist(), j.tolist()):
            if find(x) == find(y):
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = shingles(texts[z])
            a, b = sets[x], sets[y]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(y)] = find(x)
                links.append((ids[x], ids[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype({"a": pdf["id"].dtype, "b": pdf["id"].dtype})

    return link


def group_components(found: DataFrame, points: DataFrame, texts: DataFrame, same: DataFrame, link: Callable, block: int, rest_block: int) -> DataFrame:
    """(id, component) of all linked members.

    found: a written table (centre, rep). points: (id, th, columns for `link`), a row for each member.
    texts: (id, th, text). same: links (a, b) that hold anyhow.
    """
    id_type = found.schema["rep"].dataType.simpleString()
    kept = [c for c in points.columns if c not in ("id", "th")]
    texts = among(texts, found.select(F.col("rep").alias("id")))
    sizes = materialize(found.groupBy("centre").agg(F.count("*").alias("m")).where("m > 1").select("centre", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "sizes")
    members = hot_join(found, sizes, "centre").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def verified(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        full = rows.join(points, "id").join(texts, ["id", "th"]).select(*keys, "id", "th", "comp", "probe", *kept, "text")
        return materialize(full.groupBy(*keys).applyInPandas(link, f"a {id_type}, b {id_type}"), name)

    own = members.select(
        "centre", F.explode(F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block"),
        F.col("rep").alias("id"), F.col("rep").alias("comp"), F.lit(True).alias("probe"),
    )
    links = verified(own, ["centre", "block"], "links")
    labels = connected_components(links.union(same))

    many = members.where("blocks > 1").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    many = materialize(many.select("centre", "blocks", "block", "rep", "comp"), "many")
    by_comp = many.groupBy("centre", "comp").agg(F.count("*").alias("m"))
    main = by_comp.groupBy("centre").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.sum("m").alias("all"), F.max("m").alias("most")).where("all > most")
    main = materialize(main.select("centre", "main", F.ceil((F.col("all") - F.col("most")) / rest_block).cast("int").alias("parts")), "main")
    if not main.isEmpty():
        wide = F.ceil(F.col("blocks") * block / rest_block).cast("int")
        spread = materialize(hot_join(many, main, "centre").withColumn("wide", wide).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("wide")).cast("int")), "spread")
        rest = spread.where("comp <> main").select("centre", F.pmod(F.xxhash64("rep", F.lit("rest")), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("block"), F.col("rep").alias("id"), "comp", F.lit(True).alias("probe"))
        every = spread.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.col("rep").alias("id"), "comp", F.lit(False).alias("probe"))
        both = rest.unionByName(every).groupBy("centre", "part", "block", "id").agg(F.first("comp").alias("comp"), F.max("probe").alias("probe"))
        across = verified(both, ["centre", "part", "block"], "across")
        if not across.isEmpty():
            before = labels
            labels = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(across))
            discard(before)
        discard(spread, across)
    discard(sizes, links, many, main)
    return labels
