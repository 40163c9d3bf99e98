"""Evidence scoring, budgeted selection, grading, claims and their grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import content_terms

# Words that carry no content, and words that negate, in Vietnamese claims.
STOPWORDS = ("các", "cho", "của", "là", "một", "những", "theo", "trong", "tại", "và", "về")
NEGATIONS = ("bãi", "cấm", "chưa", "hủy", "không", "ngoại", "trừ")
INACTIVE = ("hết hiệu lực", "hết hiệu lực toàn bộ", "ngưng hiệu lực", "inactive", "expired", "repealed")
NUMBER = r"\d+(?:[.,]\d+)*%?"


def _match(value: Column, references: Column) -> Column:
    """Null without references, else whether the value is among them."""
    norm = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.when(F.size(references) > 0, F.coalesce(F.array_contains(F.transform(references, norm), norm(value)), F.lit(False)))


def applicability(inactive: Column, document_match: Column, article_match: Column, status: Column) -> Column:
    any_ref = document_match.isNotNull() | article_match.isNotNull()
    every = F.coalesce(document_match, F.lit(True)) & F.coalesce(article_match, F.lit(True))
    return (
        F.when(inactive, F.lit("inactive")).when(any_ref & every, F.lit("explicit_match")).when(any_ref, F.lit("reference_mismatch"))
        .when(status.isNull() | (F.trim(status) == ""), F.lit("unknown")).otherwise(F.lit("compatible"))
    )


def score_evidence(hits: DataFrame, boost: float = 2.0, overlap_weight: float = 1.0, inactive_penalty: float = 2.0, enabled: bool = True) -> DataFrame:
    """hits(query_id, chunk_id, rank, text, question, document_numbers, article_numbers, document_number, article_number, effect_status) with the selection signals and `selection_order`."""
    doc, art = _match(F.col("document_number"), F.col("document_numbers")), _match(F.col("article_number"), F.col("article_numbers"))
    inactive = F.coalesce(F.lower(F.trim("effect_status")).isin(*INACTIVE), F.lit(False))
    q = content_terms(F.col("question"))
    e = content_terms(F.concat_ws(" ", "text", "document_number", "article_number"))
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, e)) / F.size(q)).otherwise(F.lit(0.0))
    df = hits.withColumns({"document_match": doc, "article_match": art, "inactive": inactive, "overlap": overlap})
    matches = F.coalesce(F.col("document_match").cast("int"), F.lit(0)) + F.coalesce(F.col("article_match").cast("int"), F.lit(0))
    score = 1.0 / F.col("rank")
    if enabled:
        score = score + boost * matches + overlap_weight * F.col("overlap") - F.when(F.col("inactive"), inactive_penalty).otherwise(0.0)
    df = df.withColumn("selection_score", F.round(score, 12)).withColumn("applicability", applicability(F.col("inactive"), F.col("document_match"), F.col("article_match"), F.col("effect_status")))
    order = [F.desc("selection_score"), "inactive", "rank", "chunk_id"] if enabled else ["inactive", "rank", "chunk_id"]
    return df.withColumn("selection_order", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def select_within_budget(scored: DataFrame, max_evidence: int = 8, max_tokens: int = 2000, max_per_document: int | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, selection_order, reason, selection_rank): greedy in order; what doesn't fit is skipped and later, smaller items may still fit.

    Duplicates of a chunk count once, at their best place. One fold over a query's candidates, of
    which retrieval bounds the number.
    """
    once = scored.groupBy("query_id", "chunk_id").agg(F.min(F.struct("selection_order", "document_id", "token_count")).alias("x")).select("query_id", "chunk_id", "x.*")
    lists = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("selection_order", "chunk_id", "document_id", F.col("token_count").cast("long").alias("tokens")))).alias("c"))
    start = F.expr("named_struct('n', 0, 'used', 0L, 'docs', cast(array() as array<string>), 'out', cast(array() as array<struct<selection_order:int,chunk_id:string,document_id:string,reason:string,selection_rank:int>>))")

    def step(acc, x):
        per_doc = F.size(F.filter(acc["docs"], lambda d: d == x["document_id"].cast("string")))
        reason = F.when(acc["n"] >= max_evidence, F.lit("max_evidence"))
        if max_per_document is not None:
            reason = reason.when(per_doc >= max_per_document, F.lit("document_cap"))
        reason = reason.when(acc["used"] + x["tokens"] > max_tokens, F.lit("token_budget")).otherwise(F.lit("selected"))
        take = reason == "selected"
        row = F.struct(x["selection_order"].cast("int").alias("selection_order"), x["chunk_id"].cast("string").alias("chunk_id"), x["document_id"].cast("string").alias("document_id"), reason.alias("reason"), F.when(take, acc["n"] + 1).alias("selection_rank"))
        return F.struct(
            (acc["n"] + take.cast("int")).alias("n"), (acc["used"] + F.when(take, x["tokens"]).otherwise(F.lit(0).cast("long"))).alias("used"),
            F.when(take, F.concat(acc["docs"], F.array(x["document_id"].cast("string")))).otherwise(acc["docs"]).alias("docs"), F.concat(acc["out"], F.array(row)).alias("out"),
        )

    return lists.select("query_id", F.explode(F.aggregate("c", start, step)["out"]).alias("r")).select("query_id", "r.*")


def grade_context(queries: DataFrame, evidence: DataFrame, minimum: int = 1) -> DataFrame:
    """One row a query: coverage, consistency and applicability scores, their minimum, missing aspects.

    queries(query_id, wants_document, wants_article); evidence(query_id, evidence_id, chunk_id,
    document_match, article_match, applicability, overlap).
    """
    e = evidence.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("evidence_id").alias("de"), F.countDistinct("chunk_id").alias("dc"), F.max(F.coalesce("document_match", F.lit(False))).alias("doc"),
        F.max(F.coalesce("article_match", F.lit(False))).alias("art"), F.avg((~F.col("applicability").isin("inactive", "reference_mismatch")).cast("double")).alias("app"), F.max("overlap").alias("relevance"),
    )
    df = queries.join(e, "query_id", "left").na.fill(0, ["n", "de", "dc"]).na.fill(False, ["doc", "art"]).na.fill(0.0, ["app", "relevance"])
    unique = (F.col("de") == F.col("n")) & (F.col("dc") == F.col("n"))
    wants = F.col("wants_document").cast("int") + F.col("wants_article").cast("int")
    got = (F.col("wants_document") & F.col("doc")).cast("int") + (F.col("wants_article") & F.col("art")).cast("int")
    coverage = F.least(F.col("n") / F.lit(float(minimum)), F.lit(1.0))
    coverage = F.when(wants > 0, F.least(coverage, got / wants)).otherwise(coverage)
    missing = F.array_compact(F.array(
        F.when(F.col("n") < minimum, F.lit("minimum_evidence_count")), F.when(~unique, F.lit("unique_evidence_identity")),
        F.when(F.col("wants_document") & ~F.col("doc"), F.lit("document_reference_match")), F.when(F.col("wants_article") & ~F.col("art"), F.lit("article_reference_match")),
        F.when((F.col("n") > 0) & (F.col("app") == 0), F.lit("applicable_evidence")),
    ))
    df = df.withColumn("coverage_score", coverage).withColumn("consistency_score", unique.cast("double")).withColumn("missing_aspects", missing)
    return df.select("query_id", F.col("n").alias("evidence_count"), F.col("relevance").alias("relevance_score"), "coverage_score", "consistency_score", F.col("app").alias("applicability_score"), F.least("coverage_score", "consistency_score", "app").alias("score"), "missing_aspects", (F.size("missing_aspects") == 0).alias("is_sufficient"))


def split_claims(answer: Column) -> Column:
    """Sentences of each line; a sentence of markers only goes with the one before it."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(r".+?(?:[.!?;](?=\s|$)|$)"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")))
    marker = lambda s: s.rlike(r"^(?:\s*\[(?:[^\[\]]*E[1-9][0-9]*[^\[\]]*)\]\s*)+$")
    start = F.expr("cast(array() as array<string>)")
    glue = lambda acc, s: F.when(marker(s) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(parts, start, glue)


def evidence_markers(claim: Column) -> Column:
    """Evidence ids inside brackets, in order, each once."""
    inside = F.array_join(F.regexp_extract_all(claim, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), " ")
    return F.array_distinct(F.regexp_extract_all(inside, F.lit(r"\bE[1-9][0-9]*\b"), F.lit(0)))


def claim_text(claim: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(claim, r"\[([^\[\]]+)\]", "")), r"^(?:[-•]\s+|\d+[.)]\s+)", ""))
    return F.when(bare == "", F.lit("claim_without_visible_text")).otherwise(bare)


def verify_claims(answers: DataFrame, evidence: DataFrame, min_support: float = 0.25, min_terms: int = 2, max_claims: int = 20) -> DataFrame:
    """answers(question_id, answer, citation_ids); evidence(question_id, evidence_id, text) -> a row for each claim.

    Claims meet the evidence that they mark and that the answer cites; support is the share of the
    claim's content words there; numbers and negations of the claim must occur there.
    """
    claims = answers.select("question_id", "citation_ids", F.posexplode(F.slice(split_claims(F.col("answer")), 1, max_claims)).alias("pos", "segment"))
    claims = claims.select("question_id", "citation_ids", F.concat(F.lit("C"), (F.col("pos") + 1).cast("string")).alias("claim_id"), claim_text(F.col("segment")).alias("claim_text"), evidence_markers(F.col("segment")).alias("markers"))
    marked = claims.select("question_id", "claim_id", "citation_ids", F.explode("markers").alias("evidence_id")).join(evidence, ["question_id", "evidence_id"], "left")
    cited = F.array_contains("citation_ids", F.col("evidence_id"))
    known = F.col("text").isNotNull()
    per = marked.groupBy("question_id", "claim_id").agg(
        F.max(~known).alias("unknown"), F.max(~cited).alias("uncited"), F.max(known & cited).alias("linked"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(known & cited, F.struct("evidence_id", "text")))), lambda x: x["text"])).alias("evidence_text"),
    )
    df = claims.join(per, ["question_id", "claim_id"], "left").na.fill(False, ["unknown", "uncited", "linked"]).na.fill("", ["evidence_text"])
    df = df.withColumn("ct", content_terms(F.col("claim_text"), STOPWORDS)).withColumn("et", content_terms(F.col("evidence_text"), STOPWORDS))
    support = F.when(F.size("ct") > 0, F.size(F.array_intersect("ct", "et")) / F.size("ct")).otherwise(F.lit(0.0))
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit(NUMBER), F.lit(0))
    neg = F.array(*[F.lit(x) for x in NEGATIONS])
    df = df.withColumn("lexical_support", support).withColumn("numeric_match", F.size(F.array_except(numbers("claim_text"), numbers("evidence_text"))) == 0)
    df = df.withColumn("negation_match", F.size(F.array_except(F.array_intersect("ct", neg), F.array_intersect("et", neg))) == 0)
    errors = F.array_compact(F.array(
        F.when(F.size("markers") == 0, F.lit("missing_inline_evidence")), F.when(F.col("unknown"), F.lit("unknown_evidence_marker")), F.when(F.col("uncited"), F.lit("answer_marker_missing_citation")),
        F.when(F.size("ct") < min_terms, F.lit("claim_too_short")), F.when(F.col("linked") & (F.col("lexical_support") < min_support), F.lit("insufficient_lexical_support")),
        F.when(~F.col("linked"), F.lit("no_linked_evidence")), F.when(~F.col("numeric_match"), F.lit("numeric_mismatch")), F.when(~F.col("negation_match"), F.lit("negation_mismatch")),
    ))
    return df.withColumn("errors", errors).select("question_id", "claim_id", "claim_text", "markers", "lexical_support", "numeric_match", "negation_match", "errors", (F.size("errors") == 0).alias("supported"))


def unused_citations(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """(question_id, evidence_id): cited, but marked in no claim."""
    cited = answers.select("question_id", F.explode("citation_ids").alias("evidence_id"))
    used = claims.select("question_id", F.explode("markers").alias("evidence_id"))
    return cited.join(used, ["question_id", "evidence_id"], "left_anti").distinct()


def salvage_claims(claims: DataFrame) -> DataFrame:
    """One row an answer: its supported claims in order with their markers before the last mark, and how many went."""
    body = F.rtrim("claim_text")
    marks = F.array_join(F.transform("markers", lambda m: F.concat(F.lit("["), m, F.lit("]"))), " ")
    ends = body.rlike(r"[.!?;]$")
    rendered = F.when(ends, F.concat(F.regexp_replace(body, r"\s*[.!?;]$", ""), F.lit(" "), marks, F.right(body, F.lit(1)))).otherwise(F.concat(body, F.lit(" "), marks))
    n = F.regexp_extract("claim_id", r"(\d+)", 1).cast("int")
    return claims.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct(n.alias("n"), rendered.alias("t"))))), lambda x: x["t"]), "\n").alias("answer"),
        F.count_if(F.col("supported")).alias("retained"), F.count_if(~F.col("supported")).alias("dropped"),
    )


def repair_gates(claims: DataFrame) -> DataFrame:
    """Whether every failing claim fails by numbers only (repair), or by numbers and negations only (salvage)."""
    bad = ~F.col("supported")
    only = lambda allowed: F.size(F.array_except("errors", F.array(*[F.lit(x) for x in allowed]))) == 0
    return claims.groupBy("question_id").agg(
        (F.max(bad) & F.every(~bad | only(("numeric_mismatch",)))).alias("can_repair"), (F.max(bad) & F.max("supported") & F.every(~bad | only(("numeric_mismatch", "negation_mismatch")))).alias("can_salvage")
    )


def verify_citations(citations: DataFrame, evidence: DataFrame, fields: list[str]) -> DataFrame:
    """Citations with `known` and `identical`: all fields equal the evidence's, null for null."""
    e = evidence.select("question_id", "evidence_id", F.lit(True).alias("known"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = citations.join(e, ["question_id", "evidence_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return joined.withColumn("identical", F.col("known") & same).drop(*[f"__{f}" for f in fields])


def extractive_answer(evidence: DataFrame) -> DataFrame:
    """One answer a question: `[E#] text` lines in the order of evidence."""
    n = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    line = F.concat(F.lit("["), "evidence_id", F.lit("] "), "text")
    return evidence.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), line.alias("t")))), lambda x: x["t"]), "\n").alias("answer"))


def is_vietnamese(text: Column) -> Column:
    """Texts of 40 characters or more must hold a letter that only Vietnamese has. ASCII alone, told by its bytes, isn't searched."""
    return (F.length(text) < 40) | ((F.octet_length(text) > F.length(text)) & text.rlike("[\u1EA0-\u1EF9ĂăÂâĐđÊêÔôƠơƯư]"))


def render_answer(answer: Column) -> Column:
    """Without evidence markers; single spaces, none before marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"\[(E[1-9]\d*)\]", " "), r"\s+", " "), r"\s+([,.;:!?])", "$1"))


def derive_verdict(relations: Column, coverage: Column) -> Column:
    """Contradicted if any relation conflicts; insufficient if coverage isn't complete or any relation is insufficient; else supported."""
    return F.when(F.array_contains(relations, "CONFLICT"), F.lit("contradicted")).when((coverage != "COMPLETE") | F.array_contains(relations, "INSUFFICIENT"), F.lit("insufficient")).otherwise(F.lit("supported"))
