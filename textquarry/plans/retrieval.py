"""Compositions: batch retrieval over all queries at once, and graph expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators import bm25, fusion, graph, query, vectors
from textquarry.session import materialize


@dataclass(frozen=True)
class Limits:
    top_k: int = 10
    candidate_k: int = 20
    rrf_constant: int = 60
    max_variants: int = 3
    fusion_k: int = 20  #: seeds of the seed-limited rerank
    max_candidates: int = 100  #: most candidates a reranker takes


@dataclass(frozen=True)
class Corpus:
    """What searches run over: a lexical index, vectors (chunk_id, embedding), texts (chunk_id, text) and the embedder of the vectors. Without a stored index the texts are read for the asked terms, once for all queries."""

    index: bm25.Bm25Index | None
    vectors: DataFrame
    texts: DataFrame
    embed: Callable[[DataFrame, str], DataFrame]


def active_variants(queries: DataFrame, multi_query: bool = False, max_variants: int = 3) -> DataFrame:
    """(query_id, variant_id, text) of queries(query_id, question, rewritten): the rewritten question alone where there is one, else the planned variants or the question."""
    asked = F.coalesce("rewritten", F.trim(F.coalesce("question", F.lit(""))))
    if not multi_query:
        return queries.select("query_id", F.lit("qv-active").alias("variant_id"), asked.alias("text"))
    rewritten = queries.where("rewritten is not null").select("query_id", F.lit("qv-active").alias("variant_id"), asked.alias("text"))
    planned = query.plan_variants(queries.where("rewritten is null"), "query_id", "question", max_variants)
    return rewritten.union(planned.select("query_id", "variant_id", "text"))


def _searches(variants: DataFrame) -> DataFrame:
    return materialize(variants.withColumn("search_id", F.concat_ws(":", "variant_id", F.col("query_id").cast("string"))), "variants")


def branches(variants: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """(query_id, variant_id, branch, chunk_id, rank, score): both searches of every variant of every query, in one plan each, written once for all that reads them."""
    asked = _searches(variants)
    index = corpus.index or bm25.index_for(asked, "text", corpus.texts, "chunk_id", "text")
    lexical = bm25.search(bm25.plan_queries(asked, index, "search_id", "text"), index, k).withColumn("branch", F.lit("bm25"))
    embedded = corpus.embed(asked.select("search_id", "text"), "text")
    dense = vectors.cosine_top_k(embedded, corpus.vectors, k, "search_id", "chunk_id", "embedding").withColumn("branch", F.lit("dense"))
    both = lexical.unionByName(dense).withColumnRenamed("query_id", "search_id").join(asked.select("search_id", "query_id", "variant_id"), "search_id")
    return materialize(both.select("query_id", "variant_id", "branch", "chunk_id", "rank", "score"), "branches")


def matched_branches(variants: DataFrame, corpus: Corpus) -> DataFrame:
    """(query_id, variant_id, branch): the searches of branches() that have any hit, found without ranking.

    A lexical search has one if a chunk holds a term of it; a dense one if its vector is valid and the
    corpus has a valid one.
    """
    asked = _searches(variants)
    lexical = bm25.matched(asked, corpus.index, "search_id", "text").select(F.col("query_id").alias("search_id"), F.lit("bm25").alias("branch"))
    any_vector = corpus.vectors.where(vectors.is_valid(F.col("embedding"))).select(F.lit(True).alias("any")).limit(1)
    embedded = corpus.embed(asked.select("search_id", "text"), "text")
    dense = embedded.where(vectors.is_valid(F.col("embedding"))).crossJoin(F.broadcast(any_vector)).select("search_id", F.lit("dense").alias("branch"))  # one row
    return materialize(lexical.union(dense).join(asked.select("search_id", "query_id", "variant_id"), "search_id").select("query_id", "variant_id", "branch"), "matched")


def hybrid(found: DataFrame, top_k: int, limits: Limits = Limits()) -> DataFrame:
    """Reciprocal rank fusion over all variants and branches of each query; with one variant this is the plain fusion of its two lists."""
    return fusion.multi_query_fusion(found, limits.rrf_constant, top_k)


def hybrid_warnings(variants: DataFrame, found: DataFrame, multi_query: bool) -> DataFrame:
    """(query_id, warnings): empty branches, with the variant's name if there are several, and queries without any hit."""
    wanted = variants.select("query_id", "variant_id", F.explode(F.array(F.lit("bm25"), F.lit("dense"))).alias("branch"))
    empty = wanted.join(found, ["query_id", "variant_id", "branch"], "left_anti")
    parts = ["variant_id"] * multi_query + ["branch"]
    said = empty.select("query_id", F.concat_ws(":", *parts, F.concat(F.lit("no_"), "branch", F.lit("_matches"))).alias("w"))
    none = variants.select("query_id").distinct().join(found, "query_id", "left_anti").select("query_id", F.lit("no_hybrid_matches").alias("w"))
    return said.union(none).groupBy("query_id").agg(F.array_sort(F.collect_set("w")).alias("warnings"))


def rerank_pool(candidates: DataFrame, questions: DataFrame, corpus: Corpus, limits: Limits, scorer=fusion.lexical_scorer) -> DataFrame:
    """The candidates of each query, scored against its question by `scorer`, cut to top_k."""
    if limits.candidate_k > limits.max_candidates:
        raise ValueError(f"candidate_k {limits.candidate_k} is beyond the reranker's {limits.max_candidates}")
    pairs = vectors.late_materialise(candidates.select("query_id", "chunk_id", "rank", "score").join(questions, "query_id"), corpus.texts, "chunk_id")
    return fusion.rerank(pairs, scorer, "question", "text", limits.top_k)


def seed_pool(limits: Limits) -> int:
    """Candidates of the seed-limited rerank: at least one place of candidate_k is left to what the seeds lead to."""
    return min(limits.fusion_k, max(limits.candidate_k - 1, 1))


STRATEGIES = ("bm25", "dense", "hybrid", "hybrid_rerank", "seed_rerank")


def search(queries: DataFrame, corpus: Corpus, strategies: tuple[str, ...] = ("hybrid",), limits: Limits = Limits(), multi_query: bool = False, scorer=fusion.lexical_scorer) -> DataFrame:
    """(query_id, strategy, chunk_id, rank, score): the hits of each strategy asked for, to top_k. queries(query_id, question, rewritten).

    Both searches run once at candidate_k for all queries and variants; every strategy is a view of
    them: the first variant's lists for bm25 and dense, their fusion, and the fusion's candidates
    reranked. An unknown strategy is refused.
    """
    if unknown := set(strategies) - set(STRATEGIES):
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    variants = active_variants(queries, multi_query, limits.max_variants)
    found = branches(variants, corpus, limits.candidate_k)
    first = found.where(F.col("variant_id").isin("qv-active", "qv1"))
    questions = queries.select("query_id", F.coalesce("rewritten", "question").alias("question"))

    def view(name: str) -> DataFrame:
        if name in ("bm25", "dense"):
            return first.where((F.col("branch") == name) & (F.col("rank") <= limits.top_k))
        if name == "hybrid":
            return hybrid(found, limits.top_k, limits)
        pool = limits.candidate_k if name == "hybrid_rerank" else seed_pool(limits)
        return rerank_pool(hybrid(found, pool, limits), questions, corpus, limits, scorer)

    out = None
    for name in dict.fromkeys(strategies):
        one = view(name).select("query_id", F.lit(name).alias("strategy"), "chunk_id", "rank", "score")
        out = one if out is None else out.union(one)
    return out


def graph_expanded(hits: DataFrame, chunk_documents: DataFrame, edges: DataFrame, restricted: Callable[[DataFrame], DataFrame], top_k: int, seed_chunks: int = 20, seed_documents: int = 5, targets: int = 20) -> DataFrame:
    """Hits, filled up by hits restricted to documents that the first hits' documents lead to.

    chunk_documents(chunk_id, document_id); `restricted` searches within (query_id, document_id).
    """
    seeds = hits.where(F.col("rank") <= seed_chunks).join(chunk_documents, "chunk_id").groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    seeds = seeds.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "document_id"))).where(F.col("pos") <= seed_documents)
    steps = graph.traverse(edges, seeds.select(F.col("query_id").alias("seed_set"), F.col("document_id").alias("id"), "pos"))
    reached = steps.withColumn("n", F.row_number().over(Window.partitionBy("seed_set").orderBy("hop", "source", "target"))).where(F.col("n") <= targets)
    more = restricted(reached.select(F.col("seed_set").alias("query_id"), F.col("target").alias("document_id")))
    both = hits.select("query_id", "chunk_id", "score", F.col("rank"), F.lit(0).alias("part")).union(more.select("query_id", "chunk_id", "score", "rank", F.lit(1)))
    once = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "rank", "score")).alias("x")).select("query_id", "chunk_id", "x.*")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "chunk_id"))
    return once.drop("rank").join(once.select("query_id", "chunk_id", F.col("rank").alias("prior")), ["query_id", "chunk_id"]).withColumn("rank", F.col("prior")).withColumn("rank", order).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", "part", "rank")
