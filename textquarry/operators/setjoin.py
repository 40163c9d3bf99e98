"""Jaccard join of shingle sets by R-trees of count vectors.

Shingles are hashed into groups, and a text's point is its counts in them. Two texts share at most
the sum of the smaller of their counts, group by group, which must reach what their sizes and the
threshold ask for.

Linking sets of A >= B shingles differ in at most B * (100 - percent) / percent of them, so that of
one section of groups more than that, at least one has no difference at all. The join therefore
searches a forest: for texts of like size there is a tree for each section, whose top level cuts
space into cells of equal counts in the section's groups, so that a text visits its own cell only,
and only in as many trees as it may have differences and one more.
Within a cell (a group of texts, in blocks) a tree of bounding boxes over counts in all groups is
walked against itself: pairs of boxes whose bound is too small are left with all that is in them.
The pairs that remain are verified on their full sets. No link is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.groups import centred, group_components, linker
from textquarry.operators.joins import hot_join
from textquarry.session import discard, materialize


@dataclass(frozen=True)
class SetJoinParams:
    shingle: int = 5  #: words
    percent: int = 80  #: least similarity: 100 * intersection >= percent * union
    groups: int = 64  #: coordinates of the points in a cell's tree
    section_groups: int = 1 << 16  #: groups of a section
    growth: float = 3.0  #: between the least sizes of neighbouring size classes
    fanout: int = 8  #: children of a box
    block: int = 192
    rest_block: int = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, from 64-bit hashes of at least k words."""
    n = len(words) - k + 1
    s = words[:n].copy()
    for i in range(1, k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    return np.unique(s)


class Sections:
    """Size classes with their numbers of sections, and the cells that a set visits."""

    def __init__(self, p: SetJoinParams):
        self.p, self.least = p, [-(-p.percent // (100 - p.percent)) if p.percent < 100 else 1 << 62]
        while self.least[-1] < 1 << 40:
            self.least.append(max(self.least[-1] + 1, int(self.least[-1] * p.growth)))
        self.bounds = np.array(self.least)

    def differences(self, n: int) -> int:
        """Most shingles in which a set of n can differ from a larger or equal one that it links with; also holds the other way round."""
        return n * (100 - self.p.percent) // self.p.percent

    def sections(self, c: int) -> int:
        top = self.least[c + 1] - 1
        return self.differences(top) + 2 + top // 4000  # two and more to spare, as empty sections don't count

    def cells(self, s: np.ndarray) -> np.ndarray:
        """Keys of the cells of a set of shingle hashes, in its own size class and in those of the smaller sets that it may link with.

        All cells have one order, those of the fullest sections first. Before its first common cell a
        set has none but such as hold a difference, so that the first `differences` + 1 are enough.
        Empty sections have a cell only where the others are too few to make sure of a common one.
        Sets so small that they link with equal sets alone have none.
        """
        out, n = [], len(s)
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        for c in range(own, -1, -1):
            if 100 * (self.least[c + 1] - 1) < self.p.percent * n:
                break
            m = self.sections(c)
            at = s % np.uint64(m)
            order = np.argsort(at, kind="stable")
            at = at[order]
            group = _mixed((s[order] // np.uint64(m)) % np.uint64(self.p.section_groups) + np.uint64(1))
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            counts = np.add.reduceat(group, start)  # a sum, so that equal counts of all groups give equal keys
            of, sizes = at[start], np.diff(np.r_[start, n])
            if len(of) <= self.differences(n):
                none = np.setdiff1d(np.arange(m, dtype=np.uint64), of, assume_unique=True)
                of, counts, sizes = np.r_[of, none], np.r_[counts, np.zeros(len(none), np.uint64)], np.r_[sizes, np.zeros(len(none), np.int64)]
            keys = _mixed(counts ^ _mixed(of + np.uint64(1) + np.uint64((c + 1) << 44)))
            out.append(keys[np.lexsort((keys, -sizes))[: self.differences(n) + 1]])
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)

    def point(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(((s >> np.uint64(17)) % np.uint64(self.p.groups)).astype(np.int64), minlength=self.p.groups).astype(np.int32)


class CountTree:
    """Packed boxes over points of counts, of any number of levels. Needs counts (n, groups) and sizes (n), the sums of the counts."""

    def __init__(self, counts: np.ndarray, percent: int, fanout: int = 8):
        self.percent, self.fanout = percent, fanout
        sizes = counts.sum(1)
        self.order = self._packed(np.c_[sizes, counts])
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]  # largest counts, least and largest size
        while len(self.levels[-1][0]) > fanout:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), fanout)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def _packed(self, points: np.ndarray) -> np.ndarray:
        """Order in which `fanout` points after another, and as many boxes of those, lie near each other: halved along the widest coordinate."""
        out, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= self.fanout:
                out.append(rows)
                continue
            here = points[rows]
            wide = int(np.argmax(here.max(0) - here.min(0)))
            half = self.fanout
            while half * 2 < len(rows):
                half *= 2
            rows = rows[np.argsort(here[:, wide], kind="stable")]
            todo += [rows[half:], rows[:half]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _may(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs of boxes may hold a link, and the bound of their overlap."""
        top, low, high = self.levels[level]
        bound = np.minimum(top[i], top[j]).sum(1)
        like = (100 * high[i] >= self.percent * low[j]) & (100 * high[j] >= self.percent * low[i])
        return like & ((100 + self.percent) * bound >= self.percent * (low[i] + low[j])), bound

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound) of the points that may link, i before j in the tree, as positions of the input."""
        level = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[level][0]), 0 if level else 1)
        while True:
            may, bound = self._may(level, i, j)
            i, j, bound = i[may], j[may], bound[may]
            if not level:
                return self.order[i], self.order[j], bound
            level -= 1
            n, each = len(self.levels[level][0]), np.arange(self.fanout)
            a = np.broadcast_to((i[:, None] * self.fanout + each)[:, :, None], (len(i), self.fanout, self.fanout)).ravel()
            b = np.broadcast_to((j[:, None] * self.fanout + each)[:, None, :], (len(j), self.fanout, self.fanout)).ravel()
            fit = (a < n) & (b < n) & ((a < b) if not level else (a <= b))
            i, j = a[fit], b[fit]


def _candidates(p: SetJoinParams):
    def found(pdf, probe):
        counts = np.frombuffer(b"".join(pdf["point"]), np.int32).reshape(len(pdf), -1).astype(np.int64)
        i, j, bound = CountTree(counts, p.percent, p.fanout).pairs()
        one = probe[i] | probe[j]
        i, j, bound = i[one], j[one], bound[one]
        sizes = counts.sum(1)
        likely = np.argsort(-bound / (sizes[i] + sizes[j] - bound), kind="stable")
        return i[likely], j[likely]

    return found


def signature(sets: list[np.ndarray], sections: Sections) -> list[list]:
    """Columns (n_shingles, digest, cells, point) of sets; all but the first are null for an empty one."""
    import xxhash

    some = [len(s) > 0 for s in sets]
    return [
        [len(s) for s in sets],
        [xxhash.xxh3_128_digest(s.tobytes()) if x else None for s, x in zip(sets, some)],
        [sections.cells(s) if x else None for s, x in zip(sets, some)],
        [sections.point(s).tobytes() if x else None for s, x in zip(sets, some)],
    ]


SIGNATURE = "n_shingles long, digest binary, cells array<long>, point binary"


def linked(sig: DataFrame, texts: DataFrame, p: SetJoinParams, shingles: Callable, percent: int | Fraction | None = None) -> DataFrame:
    """(id, n_shingles, component): one row for each of sig, a written table (id, th, SIGNATURE), with the smallest id reachable over links.

    texts: (id, th, text), read for members of cells only; th tells the texts of one id apart.
    percent: the least similarity of a link where it isn't p.percent, which may be less.
    Rows that repeat an id are one text, so what either links with is linked. Rows without a digest,
    and null ids, are components of their own. Equal sets are one class, met by its smallest id.
    """
    known = sig.where("digest is not null and id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("id", "th")).alias("r"), F.first("cells").alias("cells"), F.first("point").alias("point"))
    classes = materialize(classes.select("digest", F.col("r.id").alias("rep"), F.col("r.th").alias("th"), "cells", "point"), "classes")
    found = materialize(centred(classes.select(F.explode("cells").alias("key"), "rep")), "members")
    several = known.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("id")
    same = known.select("id", "digest").join(several, "id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    points = classes.select(F.col("rep").alias("id"), "th", "point")
    link = linker(_candidates(p), shingles, percent or p.percent)
    labels = group_components(found, points, texts.where("id is not null and text is not null"), same, link, p.block, p.rest_block)
    discard(found)
    placed = classes.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("of_class"))
    out = hot_join(sig.select("id", "n_shingles", "digest"), materialize(placed, "placed"), "digest", "left")
    return out.select("id", "n_shingles", F.coalesce("of_class", "id").alias("component"))
