"""Vector codes by product quantisation; codebooks by Lloyd rounds with Elkan's bounds.

A vector is cut into parts; each part position has a codebook. Every vector part keeps, from one
pass to the next, an upper bound of its distance to its entry and a lower bound of the distance to
every entry, in a written table. An entry is passed over only if a bound proves it strictly farther;
what is left is compared in whole numbers, ties by index, so that codes are those of a full search.
When entries move, the bounds move by as much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.joins import hot_join
from textquarry.session import discard, materialize

#: Whole components are held within this, so that sums of squares and of entries fit 64 bits.
LARGEST = 1 << 26
SLICE_ROWS = 1024


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64  #: of a codebook, the parts of the smallest ids; fewer if there are fewer vectors; at most 256
    rounds: int = 2
    scale: int = 256  #: components become floor(scale * x)


def _down(x: np.ndarray) -> np.ndarray:
    """float32 at or below x, whatever was rounded on the way to it (64-bit results of a few operations)."""
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


class Elkan:
    """One part position: its entries, and how far they moved since the bounds were written."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        between = np.sqrt(squared(entries[:, None, :], entries[None, :, :]).astype(np.float64))
        self.half = _down(between / 2)
        self.moved = None if before is None else _up(np.sqrt(squared(entries, before).astype(np.float64)))

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, its squared distance, upper bounds, number of distances worked out) of parts x; `lower` is updated in place."""
        rows = np.arange(len(x))
        if self.moved is not None:
            lower[:] = _down(np.maximum(lower.astype(np.float64) - self.moved[None, :], 0))
            upper = _up(upper.astype(np.float64) + self.moved[at])

        def open_entries() -> np.ndarray:
            may = (lower <= upper[:, None]) & (self.half[at] <= upper[:, None])
            may[rows, at] = False
            return may

        # the own entry's distance is needed for the sums of errors in any case, and makes the upper bound tight
        best = squared(x, self.entries[at])
        done = len(x)
        upper = _up(np.sqrt(best.astype(np.float64)))
        lower[rows, at] = _down(np.sqrt(best.astype(np.float64)))
        i, k = np.nonzero(open_entries())
        done += len(i)
        found = squared(x[i], self.entries[k])
        lower[i, k] = _down(np.sqrt(found.astype(np.float64)))
        # least (distance, index) of each part: candidates in descending order, so that the least is written last
        order = np.lexsort((-k, -found))
        first, first_k = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        first[i[order]], first_k[i[order]] = found[order], k[order]
        better = (first < best) | ((first == best) & (first_k < at))
        at = np.where(better, first_k, at)
        best = np.where(better, first, best)
        return at, best, np.where(better, _up(np.sqrt(best.astype(np.float64))), upper), done


def _floats(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1)


def _assign(state: DataFrame, books: np.ndarray, before: np.ndarray | None, id_type: str, label_type: str, last: bool) -> DataFrame:
    """A pass: state (id, label, x, and code, upper, lower where `before` is given) -> the same with new codes and bounds; `last`: error instead of bounds."""
    parts, entries, width = books.shape
    out = f"id {id_type}, label {label_type}, " + ("code binary, error long" if last else "x binary, code binary, upper binary, lower binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Elkan(books[j], None if before is None else before[j]) for j in range(parts)]
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                n = batch.num_rows
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(n, parts, width).astype(np.int64)
                if before is None:
                    at, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, entries), np.float32)
                else:
                    at = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                    upper, lower = _floats(batch.column("upper"), n), _floats(batch.column("lower"), n).reshape(n, parts, entries).copy()
                error, new, bound = np.zeros(n, np.int64), np.empty((n, parts), np.uint8), np.empty((n, parts), np.float32)
                for j in range(parts):
                    new[:, j], best, bound[:, j], _ = searches[j].assign(x[:, j], at[:, j], upper[:, j], lower[:, j])
                    error += best
                rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                more = [rows(new), pa.array(error)] if last else [batch.column("x"), rows(new), rows(bound), rows(lower)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *more], names=["id", "label", "code", "error"] if last else ["id", "label", "x", "code", "upper", "lower"])

    return state.mapInArrow(run, out)


def _entry_sums(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry: partial sums of tasks, then one row for each entry in use, at most parts * entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(-1, width)
            cell = (np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * entries).ravel()
            np.add.at(sums, cell, x)
            counts += np.bincount(cell, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used].tolist(), pa.list_(pa.int64())), pa.array(counts[used])], names=["cell", "sums", "n"])

    partial = state.select("x", "code").mapInArrow(run, "cell long, sums array<long>, n long")
    each = partial.groupBy("cell").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("n").alias("n"))
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for row in each.collect():
        sums[row["cell"]], counts[row["cell"]] = row["sums"], row["n"]
    return sums.reshape(books.shape), counts.reshape(parts, entries)


def whole_vectors(df: DataFrame, p: CodeParams, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): floor(scale * component), of vectors whose components are all finite and cut evenly into parts."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % p.parts == 0))
    bounded = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * p.scale, F.lit(2.0 * LARGEST)), F.lit(-2.0 * LARGEST))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return rows.select("id", "label", F.transform("v", bounded).alias("v"))


def encode_vectors(df: DataFrame, params: CodeParams = CodeParams(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """The coded vectors (id, label, code, error, label_error), and the codebooks (part, entry, component).

    code is one byte a part; error sums the squared distances of the parts; label_error sums errors
    over equal labels, nulls together. Vectors that are null or empty, hold null or non-finite
    components, don't cut evenly into parts, or whose length isn't that of the first kept vector have
    no row. Repeated rows are coded each, and count in codebooks each; of equal ids the smaller vector
    comes first; null ids come last. Components beyond 2**26 after scaling are held there. An empty
    table gives an empty result and codebooks without entries.
    """
    p = params
    ids, labels = df.schema[id_col].dataType.simpleString(), df.schema[label_col].dataType.simpleString()
    whole = materialize(whole_vectors(df, p, id_col, vector_col, label_col), "vectors")
    order = [F.asc_nulls_last("id"), F.asc("v")]
    first = whole.orderBy(*order).select(F.size("v").alias("n")).limit(1).collect()
    if not first:
        none = whole.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), np.zeros((p.parts, 0, 0), np.int64)
    same = whole.where(F.size("v") == first[0]["n"])
    seeds = np.array([r["v"] for r in same.orderBy(*order).select("v").limit(p.entries).collect()], np.int64)
    books = seeds.reshape(len(seeds), p.parts, -1).transpose(1, 0, 2).copy()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r.tobytes() for r in v], pa.binary())], names=["id", "label", "x"])

    state, before = same.mapInArrow(packed, f"id {ids}, label {labels}, x binary"), None
    for r in range(p.rounds):
        coded = materialize(_assign(state, books, before, ids, labels, last=False), f"codes{r}")
        if before is not None:
            discard(state)
        sums, counts = _entry_sums(coded, books)
        state, before = coded, books
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    done = materialize(_assign(state, books, before, ids, labels, last=True).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "codes")
    discard(state, whole)
    sums = done.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = hot_join(done, sums, "key")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
