"""Answers over tables of questions and hits that fail closed: what isn't graded sufficient and verified is an abstention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import evidence
from textquarry.session import materialize

# Fixed value: the text of an abstention.
ABSTENTION = "Hệ thống chưa tìm thấy căn cứ pháp luật đủ rõ trong dữ liệu hiện có để trả lời chắc chắn."


def extract(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, answer, citation_ids): the evidence itself, marked, which cites all of it."""
    cited = found.groupBy("question_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("citation_ids"))
    return evidence.extractive_answer(found).join(cited, "question_id")


def answer_questions(
    queries: DataFrame, hits: DataFrame, generate: Callable[[DataFrame, DataFrame], DataFrame] = extract, max_evidence: int = 8, max_tokens: int = 2000, minimum: int = 1, min_support: float = 0.25, in_force: bool = False,
) -> DataFrame:
    """One row for each query: query_id, answer, citation_ids, insufficient_evidence, warnings, evidence_count, hit_count, score, missing_aspects, claims, supported_claims.

    queries(query_id, question, wants_document, wants_article), ids unique; hits as
    evidence.score_evidence takes them, with document_id and token_count. Evidence is scored, taken
    within the budget, numbered, and graded against what the question wants; with `in_force`, evidence
    that is out of force doesn't count as a reference it wants. Only sufficient
    questions reach `generate`, which gets (question_id, question) and their (question_id,
    evidence_id, text) and gives (question_id, answer, citation_ids). An answer stands if it has
    claims, every one of them is supported by evidence that it marks and cites, and every citation is
    known and used. All else, a missing or repeated answer and a question without hits among it, is
    an abstention that says why. Answers to questions that weren't asked are dropped.
    """
    scored = materialize(evidence.score_evidence(hits), "scored")
    picked = evidence.select_within_budget(scored, max_evidence, max_tokens).where("reason = 'selected'").select("query_id", "chunk_id", "selection_rank")
    signals = scored.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "text", "document_match", "article_match", "applicability", "overlap")
    if in_force:
        for match in ("document_match", "article_match"):
            signals = signals.withColumn(match, F.col(match) & (F.col("applicability") != "inactive"))
    found = materialize(picked.join(signals, ["query_id", "chunk_id"]).withColumn("evidence_id", F.concat(F.lit("E"), "selection_rank")), "evidence")
    graded = evidence.grade_context(queries.select("query_id", "wants_document", "wants_article"), found, minimum)
    graded = materialize(graded.select("query_id", "evidence_count", "score", "missing_aspects", "is_sufficient"), "graded")

    asked = queries.join(graded.where("is_sufficient").select("query_id"), "query_id", "left_semi").select(F.col("query_id").alias("question_id"), "question")
    given = found.select(F.col("query_id").alias("question_id"), "evidence_id", "text").join(asked.select("question_id"), "question_id", "left_semi")
    said = materialize(generate(asked, given).select("question_id", "answer", "citation_ids").join(asked.select("question_id"), "question_id", "left_semi"), "answers")
    once = said.groupBy("question_id").agg(F.count("*").alias("answers"), F.first("answer").alias("answer"), F.first(F.coalesce("citation_ids", F.array().cast("array<string>"))).alias("citation_ids"))
    checked = materialize(evidence.verify_claims(once.where("answers = 1"), given, min_support), "claims")
    claims = checked.groupBy("question_id").agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported_claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
    cited = once.select("question_id", F.explode("citation_ids").alias("evidence_id")).join(given.select("question_id", "evidence_id", F.lit(True).alias("known")), ["question_id", "evidence_id"], "left")
    unknown = cited.where("known is null").select("question_id", F.lit("unknown_citation").alias("e"))
    unused = evidence.unused_citations(once, checked).select("question_id", F.lit("unused_citation").alias("e"))
    loose = unknown.union(unused).groupBy("question_id").agg(F.array_sort(F.collect_set("e")).alias("loose"))

    none = F.array().cast("array<string>")
    n = hits.groupBy("query_id").agg(F.count("*").alias("hit_count"))
    of = lambda d: d.withColumnRenamed("question_id", "query_id")
    df = queries.select("query_id").join(graded, "query_id").join(n, "query_id", "left").join(of(once), "query_id", "left").join(of(claims), "query_id", "left").join(of(loose), "query_id", "left")
    df = df.na.fill(0, ["hit_count", "claims", "supported_claims"])
    faults = F.when(F.col("answers").isNull() | (F.trim(F.coalesce("answer", F.lit(""))) == ""), F.array(F.lit("missing_answer"))).when(F.col("answers") > 1, F.array(F.lit("several_answers")))
    faults = faults.when(F.col("claims") == 0, F.array(F.lit("no_claims"))).otherwise(F.concat(F.coalesce("errors", none), F.coalesce("loose", none)))
    warnings = F.when(~F.col("is_sufficient"), F.array(F.lit("insufficient_context"))).when(F.size(faults) > 0, F.concat(F.array(F.lit("citation_verification_failed")), faults)).otherwise(none)
    stands = F.size("warnings") == 0
    df = df.withColumn("warnings", warnings)
    return df.select(
        "query_id", F.when(stands, F.col("answer")).otherwise(F.lit(ABSTENTION)).alias("answer"), F.when(stands, F.col("citation_ids")).otherwise(none).alias("citation_ids"), (~stands).alias("insufficient_evidence"), "warnings",
        "evidence_count", "hit_count", "score", "missing_aspects", "claims", "supported_claims",
    )
