"""Retrieval diagnostics, candidate comparison with gates, linkability and the retrieval proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import terms
from textquarry.operators.ranks import ranked


def branch_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, overlap, jaccard) of two hit lists (query_id, chunk_id)."""
    mark = lambda d, n: d.select("query_id", "chunk_id", F.lit(1).alias(n)).distinct()
    j = mark(a, "a").join(mark(b, "b"), ["query_id", "chunk_id"], "full")
    g = j.groupBy("query_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"), F.count("*").alias("u"))
    return g.select("query_id", "overlap", (F.col("overlap") / F.col("u")).alias("jaccard"))


def document_diversity(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg((F.countDistinct("document_id") / F.count("*")).alias("diversity"))


def answer_term_coverage(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, coverage): share of an answer's distinct terms that its hits' texts hold; 0 without terms, null for a null answer. hits(query_id, text), answers(query_id, answer)."""
    want = answers.select("query_id", F.explode(F.array_distinct(terms(F.coalesce("answer", F.lit(""))))).alias("t"))
    have = hits.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).distinct().withColumn("hit", F.lit(1))
    per = want.join(have, ["query_id", "t"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("coverage"))
    known = answers.select("query_id", F.col("answer").isNotNull().alias("known")).join(per, "query_id", "left")
    return known.select("query_id", F.when(F.col("known"), F.coalesce("coverage", F.lit(0.0))).alias("coverage"))


def rank_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, mean_change): mean absolute change of rank over the chunks that both hold."""
    return a.select("query_id", "chunk_id", F.col("rank").alias("x")).join(b.select("query_id", "chunk_id", F.col("rank").alias("y")), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_change"))


def diagnose(
    queries: DataFrame, bm25: DataFrame, dense: DataFrame, hybrid: DataFrame, answers: DataFrame, low_diversity: float = 0.25, low_coverage: float = 0.2,
    references: DataFrame | None = None, warned: DataFrame | None = None, failed: DataFrame | None = None, reranked: DataFrame | None = None,
) -> DataFrame:
    """One row a query with overlap, diversity, coverage and the names of the signals that hold; queries without hits stay.

    references(query_id, matched): whether the hybrid hits hold what the question names; null where it
    names nothing. warned and failed (query_id): searches that gave warnings, or no result; a failed
    query has the signal retrieval_error and no other. reranked (as hybrid): adds its overlap and
    Jaccard with the hybrid hits, its diversity and its gain in coverage.
    """
    n = lambda d, name: d.groupBy("query_id").agg(F.count("*").alias(name))
    df = queries.select("query_id")
    for part in (n(bm25, "n_bm25"), n(dense, "n_dense"), n(hybrid, "n_hybrid"), branch_overlap(bm25, dense), document_diversity(hybrid), answer_term_coverage(hybrid, answers)):
        df = df.join(part, "query_id", "left")
    mark = lambda d, name: d.select("query_id", F.lit(True).alias(name)).distinct()
    df = df.join(references.select("query_id", "matched"), "query_id", "left") if references is not None else df.withColumn("matched", F.lit(None).cast("boolean"))
    for d, name in ((warned, "warned"), (failed, "failed")):
        df = df.join(mark(d, name), "query_id", "left") if d is not None else df.withColumn(name, F.lit(None).cast("boolean"))
    df = df.na.fill(0, ["n_bm25", "n_dense", "n_hybrid", "overlap"]).na.fill(0.0, ["jaccard", "diversity"])
    signals = F.array_compact(F.array(
        F.when(F.col("n_bm25") == 0, F.lit("no_bm25_hits")), F.when(F.col("n_dense") == 0, F.lit("no_dense_hits")), F.when(F.col("n_hybrid") == 0, F.lit("no_hybrid_hits")),
        F.when((F.col("n_bm25") > 0) & (F.col("n_dense") > 0) & (F.col("overlap") == 0), F.lit("zero_branch_overlap")),
        F.when((F.col("n_hybrid") > 0) & (F.col("diversity") < low_diversity), F.lit("low_document_diversity")), F.when(~F.col("matched"), F.lit("explicit_reference_not_retrieved")),
        F.when(F.col("coverage") < low_coverage, F.lit("low_answer_term_coverage")), F.when(F.col("warned"), F.lit("retrieval_warning")),
    ))
    df = df.withColumn("signals", F.when(F.col("failed"), F.array(F.lit("retrieval_error"))).otherwise(signals)).withColumnRenamed("matched", "explicit_match").drop("warned", "failed")
    if reranked is None:
        return df
    again = branch_overlap(hybrid, reranked).withColumnsRenamed({"overlap": "reranked_overlap", "jaccard": "reranked_jaccard"})
    again = again.join(document_diversity(reranked).withColumnRenamed("diversity", "reranked_diversity"), "query_id", "left").join(answer_term_coverage(reranked, answers).withColumnRenamed("coverage", "reranked_coverage"), "query_id", "full")
    df = df.join(again, "query_id", "left").na.fill(0, ["reranked_overlap"]).na.fill(0.0, ["reranked_jaccard", "reranked_diversity"])
    return df.withColumn("coverage_gain", F.col("reranked_coverage") - F.col("coverage"))


def signal_report(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def gate_candidates(df: DataFrame, objectives: dict[str, tuple[str, float | None, float | None]], baseline: str, id_col: str = "candidate_id") -> DataFrame:
    """Adds `reasons` and `eligible`. objectives: metric -> (max or min, threshold, most regression against the baseline).

    The baseline's values are one row. If it isn't eligible itself, no candidate is.
    """
    worse = lambda d, a, b: a < b if d == "max" else a > b
    own = [F.when(F.col(m).isNull() | F.isnan(m), F.lit(f"objective_metric_missing:{m}")) for m in objectives]
    own += [F.when(worse(d, F.col(m), F.lit(t)), F.lit(f"objective_threshold_failed:{m}")) for m, (d, t, _) in objectives.items() if t is not None]
    marked = df.withColumn("reasons", F.array_compact(F.array(*own)))
    base = marked.where(F.col(id_col) == baseline).select(*[F.col(m).alias(f"__{m}") for m in objectives], (F.size("reasons") == 0).alias("__ok"))
    joined = marked.crossJoin(F.broadcast(base))  # one row
    gates = [F.when(worse(d, F.col(m), F.col(f"__{m}") - r if d == "max" else F.col(f"__{m}") + r), F.lit(f"objective_regression_failed:{m}")) for m, (d, _, r) in objectives.items() if r is not None]
    more = F.when(F.size("reasons") > 0, F.col("reasons")).when(~F.col("__ok"), F.array(F.lit("regression_baseline_ineligible"))).otherwise(F.array_compact(F.array(*gates, F.lit(None).cast("string"))))
    return joined.withColumn("reasons", more).withColumn("eligible", F.size("reasons") == 0).drop("__ok", *[f"__{m}" for m in objectives])


def rank_checkpoints(df: DataFrame) -> DataFrame:
    """Eligible checkpoints by semantic gain, then fewer unended, fewer repetitive answers, lower loss. df(step, eligible, gain, unended, repetitive, loss)."""
    return ranked(df.where("eligible"), [F.desc("gain"), F.asc("unended"), F.asc("repetitive"), F.asc("loss"), F.asc("step")])


def compact_slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits of a text without marks, nothing between. Letters without an ASCII base go."""
    from textquarry.operators.dataset import slug

    return F.regexp_replace(slug(F.translate(F.lower(text), "đ", "")), "-", "")


def containment_links(needles: DataFrame, titles: DataFrame, least: int = 4) -> DataFrame:
    """(needle_id, title_id): titles(title_id, slug) that contain the slug of needles(needle_id, slug) of `least` characters or more.

    An inverted index of the titles' grams of `least` characters; each distinct needle meets the
    titles of its rarest gram alone, and these are looked at as a whole. A needle with a gram that no
    title has is in none. So a needle has one row in the join, whatever its length, and no title is
    met by a needle that has nothing of it. Titles come with their grams, and neither they nor the
    links are ever a broadcast, however well they compress. Null slugs are in no link.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("slug") - (least - 1)), lambda i: F.substring(F.col("slug"), i, F.lit(least))))
    parts = needles.where(F.length("slug") >= least).select("slug").distinct().select("slug", F.explode(grams).alias("gram"))
    held = titles.where(F.length("slug") >= least).select("title_id", F.col("slug").alias("title"), F.explode(grams).alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi")
    common = held.groupBy("gram").agg(F.count("*").alias("titles"))
    counted = parts.join(common, "gram", "left")
    rarest = counted.groupBy("slug").agg(F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("r")).where("r.titles > 0").select("slug", F.col("r.gram").alias("gram"))
    whole = held.hint("merge").join(rarest, "gram").where(F.contains("title", F.col("slug"))).select("slug", "title_id").distinct()
    return whole.hint("merge").join(needles.select("needle_id", "slug"), "slug").select("needle_id", "title_id").distinct()


def linkability(links: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, state): unambiguous with one title, ambiguous with more, unresolved without."""
    n = needles.select("needle_id").distinct().join(links.groupBy("needle_id").agg(F.count("*").alias("n")), "needle_id", "left")
    return n.select("needle_id", F.when(F.col("n") == 1, F.lit("unambiguous")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("unresolved")).alias("state"))


def proxy_recall(hits: DataFrame, links: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """One row: share of links (query_id, document_id) whose document is in the first k hit rows (query_id, document_id, rank)."""
    best = links.join(hits, ["query_id", "document_id"], "left").groupBy("query_id", "document_id").agg(F.min("rank").alias("r"))
    return best.agg(F.count("*").alias("links"), *[F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in cutoffs])


def marker_census(df: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """(marker, documents): how many texts hold each pattern."""
    t = F.coalesce(text_col, F.lit(""))
    row = df.agg(*[F.count_if(t.rlike(p)).alias(m) for m, p in patterns.items()])
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in patterns]), F.array(*patterns))).alias("marker", "documents"))


def chunk_census(chunks: DataFrame) -> DataFrame:
    """(strategy, chunks, share, tokens, with_article): strategy shares of a chunk table, with repeated texts counted in `repeated`, told by their SHA-256. The chunks are read once."""
    per = chunks.withColumn("text", F.sha2("text", 256)).groupBy("strategy").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if(F.col("structure.article_number").isNotNull()).alias("with_article"), (F.count("text") - F.countDistinct("text")).alias("repeated"))
    return per.withColumn("share", F.col("chunks") / F.sum("chunks").over(Window.partitionBy()))  # a row a strategy
