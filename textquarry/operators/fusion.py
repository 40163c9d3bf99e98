"""Rank fusion, reranking and their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import content_terms


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def reciprocal_rank_fusion(bm25: DataFrame, dense: DataFrame, constant: int = 60, top_k: int = 10) -> DataFrame:
    """Two hit lists (query_id, chunk_id, rank, score) to one: score is the sum of 1 / (constant + rank) over the sides that hold the chunk."""
    a = bm25.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    part = lambda r: F.coalesce(1.0 / (F.lit(constant) + F.col(r)), F.lit(0.0))
    fused = a.join(b, ["query_id", "chunk_id"], "full").withColumn("score", F.round(part("bm25_rank") + part("dense_rank"), 12))
    return _ranked(fused, F.desc("score"), "chunk_id").where(F.col("rank") <= top_k)


def fusion_conflicts(hits: DataFrame) -> DataFrame:
    """Chunks or ranks that one query holds twice: fusion of such a list is refused."""
    twice = lambda key: hits.groupBy("query_id", key).agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit(f"duplicate_{key}").alias("problem"), F.col(key).cast("string").alias("value"))
    return twice("chunk_id").union(twice("rank"))


def multi_query_fusion(branches: DataFrame, constant: int = 60, top_k: int = 10) -> DataFrame:
    """branches (query_id, variant_id, branch, chunk_id, rank, score): the sum over all variants and branches, the best rank of each branch, and the contributions."""
    fused = branches.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 12).alias("score"),
        *[F.min(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank") for b in ("bm25", "dense")],
        *[F.min_by(F.when(F.col("branch") == b, F.col("score")), F.when(F.col("branch") == b, F.struct("rank", "variant_id"))).alias(f"{b}_score") for b in ("bm25", "dense")],
        F.count("*").alias("n_contributions"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "variant_id", "branch", "rank")))).alias("contributions"),
    )
    return _ranked(fused, F.desc("score"), "chunk_id").where(F.col("rank") <= top_k)


#: Labels of the lines of a rerank text.
RERANK_LABELS = {"document_title": "Văn bản", "document_number": "Số ký hiệu", "document_type": "Loại văn bản", "effect_status": "Tình trạng hiệu lực", "article_number": "Điều", "article_title": "Tên điều"}


def rerank_text(columns: list[str], text: Column) -> Column:
    """`label: value` lines of the known columns that aren't null, then the text."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{RERANK_LABELS.get(c, c)}: "), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws("\n", *lines, text)


def lexical_scorer(question: Column, text: Column) -> Column:
    """Default scorer without a model: share of the question's terms that the text holds."""
    q = content_terms(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_terms(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer, question_col: str = "question", text_col: str = "text", top_k: int = 10, pool: int | None = None) -> DataFrame:
    """The pool's hits by (score of the pair, prior rank, id). A cross-encoder is a scorer that gives a pandas UDF column."""
    kept = hits if pool is None else hits.where(F.col("rank") <= pool)
    scored = kept.withColumnRenamed("rank", "prior_rank").withColumnRenamed("score", "prior_score").withColumn("score", F.round(scorer(F.col(question_col), F.col(text_col)), 12))
    return _ranked(scored, F.desc("score"), "prior_rank", "chunk_id").where(F.col("rank") <= top_k)


def rerank_problems(reranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, problem): hits that weren't candidates, hits twice, ranks that aren't 1..n."""
    foreign = reranked.join(candidates, ["query_id", "chunk_id"], "left_anti").select("query_id", F.lit("not_a_candidate").alias("problem"))
    twice = reranked.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("duplicate").alias("problem"))
    gaps = reranked.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")).where("a <> 1 or b <> n or d <> n").select("query_id", F.lit("ranks_not_contiguous").alias("problem"))
    return foreign.union(twice).union(gaps)
