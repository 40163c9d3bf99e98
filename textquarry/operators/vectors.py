"""Exact cosine search over an array column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.session import materialize

#: Vectors of a block, of which two are multiplied at a time: 2,048 of 384 components are 6 MB, and so many scores 32 MB.
BLOCK = 2048
#: Blocks of queries whose best hits a task holds before it hands them on.
HELD_BLOCKS = 16


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def is_valid(v: Column) -> Column:
    """Finite, without nulls, and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & (norm(v) > 0)


def normalise(df: DataFrame, vec_col: str) -> DataFrame:
    """Valid vectors only, scaled to length one."""
    v = F.col(vec_col)
    return df.where(is_valid(v)).withColumn("__n", norm(v)).withColumn(vec_col, F.transform(v, lambda x: x.cast("double") / F.col("__n"))).drop("__n")


def invalid(df: DataFrame, vec_col: str) -> DataFrame:
    return df.where(~is_valid(F.col(vec_col)))


def _units(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The valid vectors of a batch as doubles of length one, with their ids: what normalise() gives, squares summed in the same order."""
    sizes = np.diff(np.r_[0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    at = np.flatnonzero(sizes)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is no number
    ends, units = np.cumsum(sizes), {}
    with np.errstate(all="ignore"):
        for d in np.unique(sizes[at]):
            own = at[sizes[at] == d]
            m = values[(ends[own] - d)[:, None] + np.arange(d)]
            n = np.sqrt(np.add.accumulate(m * m, 1)[:, -1])
            good = np.isfinite(m).all(1) & (n > 0)
            units.update(zip(own[good].tolist(), m[good] / n[good, None]))
    kept = sorted(units)
    return ids.take(pa.array(kept, pa.int64())), [units[k] for k in kept]


def blocks(df: DataFrame, id_col: str, vec_col: str, size: int = BLOCK) -> DataFrame:
    """(ids, n, matrix) of the valid vectors, scaled to length one, `size` in a block: ids as an array, the matrix as bytes of doubles, row by row."""
    raw = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kind = raw.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        rows = ((i, v) for b in batches for i, v in zip(*_units(b.column(0), b.column(1))))
        while part := [*itertools.islice(rows, size)]:
            matrix = np.stack([v for _, v in part])
            yield pa.RecordBatch.from_arrays([pa.array([[i.as_py() for i, _ in part]], pa.list_(part[0][0].type)), pa.array([len(part)]), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "n", "matrix"])

    return raw.mapInArrow(pack, f"ids array<{kind}>, n long, matrix binary")


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first top_k (row, id, score) of each row by score, ties by id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    return rows[place < top_k], ids[place < top_k], scores[place < top_k]


def cosine_top_k(queries: DataFrame, vectors: DataFrame, top_k: int, query_id: str, vec_id: str, vec_col: str, exclude_same: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact, ties by id, scores rounded to 6 places before ranking.

    Queries and vectors are two written tables of blocks, and every block of the one meets every
    block of the other as one matrix product: the plan is the same for any number of queries, and a
    task reads the blocks it needs from the tables. A task merges the hits of a block of queries over
    the vectors' blocks that it sees, so that it hands on top_k rows a query; these are cut once more
    within Spark before the shuffle, and after it. Vectors that aren't valid are in no result.
    """
    id_type = vectors.schema[vec_id].dataType
    out = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("chunk_id", id_type), T.StructField("score", T.DoubleType())])
    asked = materialize(blocks(queries, query_id, vec_col, block).select(F.col("ids").alias("q_ids"), F.col("n").alias("q_n"), F.col("matrix").alias("q_matrix")), "query_blocks")
    held = materialize(blocks(vectors, vec_id, vec_col, block), "vector_blocks")
    pairs = asked.crossJoin(held)  # blocks, not rows
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}

        def emit():
            for q_ids, (rows, ids, scores) in best.values():
                arrays = [pa.array([q_ids[i] for i in rows], types[0]), pa.array(ids.tolist(), types[1]), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)
            best.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, ids = batch.column("q_ids")[row].as_py(), np.array(batch.column("ids")[row].as_py())
                if q_ids[0] not in best and len(best) >= HELD_BLOCKS:
                    yield from emit()
                q = np.frombuffer(batch.column("q_matrix")[row].as_py()).reshape(len(q_ids), -1)
                scores = np.round(q @ np.frombuffer(batch.column("matrix")[row].as_py()).reshape(len(ids), -1).T, 6)
                if exclude_same:
                    scores[np.array(q_ids)[:, None] == ids[None]] = -np.inf
                edge = np.partition(scores, len(ids) - top_k, 1)[:, len(ids) - top_k, None] if len(ids) > top_k else np.float64(-np.inf)  # ties at the edge stay in
                rows, cols = np.nonzero((scores >= edge) & (scores > -np.inf))
                found = rows, ids[cols], scores[rows, cols]
                if q_ids[0] in best:
                    found = tuple(np.concatenate(x) for x in zip(best[q_ids[0]][1], found))
                best[q_ids[0]] = q_ids, _best(*found, top_k)
        yield from emit()

    found = pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k)


def metadata_filter(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns hold one of the wanted values; an empty list is no condition."""
    for col, values in wanted.items():
        if values:
            df = df.where(F.col(col).isin(values))
    return df


def late_materialise(hits: DataFrame, payload: DataFrame, payload_id: str) -> DataFrame:
    """Payload columns for the final hits only. These are written first, so that Spark knows whether they are few enough to leave the payload where it is."""
    return materialize(hits, "hits").join(payload.withColumnRenamed(payload_id, "chunk_id"), "chunk_id")


def hashing_embedder(df: DataFrame, text_col: str, dim: int = 384, out_col: str = "embedding") -> DataFrame:
    """A deterministic offline embedding: each term adds 1 or -1 at a place, both told by its MD5 digest. Stands in for a model behind the same column.

    The place is the number of the digest's first eight hex digits modulo `dim`; the sign is negative
    if the ninth is odd. Texts without terms get a null vector, which is no valid one.
    """
    from textquarry.functions.text import terms

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(words: pa.Array) -> pa.Array:
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()  # a batch's distinct terms are hashed once
        digests = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
        slots = np.array([int(h[:8], 16) % dim for h in digests], np.int64)
        signs = np.array([-1.0 if int(h[8], 16) % 2 else 1.0 for h in digests])
        code = coded.indices.to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(len(sizes)), sizes) * dim + slots[code]
        sums = np.bincount(cells, signs[code], len(sizes) * dim).astype(np.float32)
        full = np.repeat(sizes > 0, dim)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(sizes > 0, dim, 0))], pa.int32()), pa.array(sums[full], pa.float32()), mask=pa.array(sizes == 0))

    return df.withColumn(out_col, embed(terms(F.coalesce(F.col(text_col), F.lit("")))))


@dataclass(frozen=True)
class VectorIndex:
    """A written vector table (row_index, chunk_id, embedding of length one) with its manifest."""

    path: str
    manifest: dict

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def build_vector_index(chunks: DataFrame, embed, id_col: str, text_col: str, path: str, provider: dict, source: dict, buckets: int = 64) -> VectorIndex:
    """Embed chunks to `path`/vectors, resuming after an interruption, and publish the manifest at the end.

    Chunks fall into a fixed number of buckets by a hash of their id; a bucket is written as a whole,
    so that what a stopped build left is complete buckets, which are not embedded again. Another
    provider, source or dimension at the same path is refused, as are vectors that aren't finite or
    all zero. provider: provider, version, model, revision, dimension; source: artifact, version, sha256.
    """
    spark = chunks.sparkSession
    wanted = {"provider": provider, "source": source, "buckets": buckets}
    plan = f"{path}/plan"
    if (old := read_json(spark, plan)) is not None and old != wanted:
        raise ValueError(f"the vector artifact at {path} belongs to another build")
    write_json(spark, plan, wanted)
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).withColumn("bucket", F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), F.lit(buckets)).cast("int"))
    done = committed_buckets(spark, f"{path}/vectors")
    left = rows.where(~F.col("bucket").isin(done)) if done else rows
    vectors = embed(left, "text").select("chunk_id", "embedding", "bucket")
    fits = is_valid(F.col("embedding")) & (F.size("embedding") == provider["dimension"])
    checked = vectors.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no valid vector for chunk "), F.col("chunk_id").cast("string"))).cast("array<float>")))
    unit = checked.withColumn("n", norm(F.col("embedding"))).withColumn("embedding", F.transform("embedding", lambda x: (x / F.col("n")).cast("float"))).drop("n")
    unit.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk_id").write.mode("append").partitionBy("bucket").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    n = stored.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d")).first()
    if n["n"] != n["d"] or n["n"] != rows.count():
        raise ValueError(f"{n['n']} vectors of {n['d']} chunks don't match the source")
    manifest = wanted | {"records": n["n"], "metric": "cosine", "normalised": True}
    write_json(spark, f"{path}/manifest", manifest)
    return VectorIndex(path, manifest)


def committed_buckets(spark: SparkSession, path: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket="))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON object as a file in any store that Spark writes."""
    import json

    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    import json

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(path).first()["value"])


def open_vector_index(spark: SparkSession, path: str, provider: dict) -> VectorIndex:
    """A published index whose provider, model and dimension are those that will embed the queries."""
    manifest = read_json(spark, f"{path}/manifest")
    if manifest is None:
        raise ValueError(f"no published vector index at {path}")
    for key in ("provider", "version", "model", "revision", "dimension"):
        if manifest["provider"].get(key) != provider.get(key):
            raise ValueError(f"the index was built with another {key}")
    return VectorIndex(path, manifest)


def vector_problems(vectors: DataFrame, chunks: DataFrame, id_col: str, dimension: int, tolerance: float = 1e-4) -> DataFrame:
    """(chunk_id, problem): vectors of a wrong length, not finite or not of length one, ids twice, vectors without a chunk and chunks without a vector."""
    v = F.col("embedding")
    problem = F.when(v.isNull() | (F.size(v) != dimension), F.lit("dimension")).when(~is_valid(v), F.lit("not_finite_or_zero")).when(F.abs(norm(v) - 1) > tolerance, F.lit("not_normalised"))
    bad = vectors.select("chunk_id", problem.alias("problem")).where("problem is not null")
    twice = vectors.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id", F.lit("duplicate_id").alias("problem"))
    ids = chunks.select(F.col(id_col).alias("chunk_id"))
    foreign = vectors.join(ids, "chunk_id", "left_anti").select("chunk_id", F.lit("unknown_chunk").alias("problem"))
    lacking = ids.join(vectors, "chunk_id", "left_anti").select("chunk_id", F.lit("missing_vector").alias("problem"))
    return bad.union(twice).union(foreign).union(lacking)


def serving_metadata(vectors: DataFrame, chunks: DataFrame, id_col: str, filter_cols: list[str]) -> DataFrame:
    """(chunk_id, bucket, filter columns): what filters need beside the vectors, kept in the vectors' buckets and sorted by the filter columns.

    Files and row groups whose statistics rule a filter out aren't read, which is what row offsets
    and indexes do for a single file.
    """
    meta = chunks.select(F.col(id_col).alias("chunk_id"), *filter_cols)
    return vectors.select("chunk_id", "bucket").join(meta, "chunk_id").repartition("bucket").sortWithinPartitions("bucket", *filter_cols)
