"""Censuses of question-answer pairs, choice of controls from records, packets and over-long items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.dataset import stratified_sample

# Cues of kinds of questions; a pair has each kind that its question or its answer shows.
TAXONOMY = {
    "binary_yes_no": r"^(?:Có\b|Không\b|Được\b|Không được\b|Phải\b|Không phải\b|Đúng\b|Sai\b)",
    "definition": r"là gì|được hiểu là|khái niệm|định nghĩa|quy định tại khoản \d+ điều \d+ về khái niệm",
    "procedure_steps": r"thủ tục|trình tự|các bước|hồ sơ|quy trình|tiến hành",
    "rights_obligations": r"quyền|nghĩa vụ|trách nhiệm|bổn phận|được phép",
    "authority_competence": r"thẩm quyền|cơ quan nào|ai có quyền|chủ tịch|bộ trưởng|ủy ban",
    "penalty_sanction": r"xử phạt|phạt tiền|tước quyền|hình phạt|tịch thu|phạt cảnh cáo|truy cứu",
    "condition_eligibility": r"điều kiện|tiêu chuẩn|đối tượng|yêu cầu|nguyên tắc",
    "deadline_temporal": r"thời hạn|thời gian|ngày|tháng|năm|bao lâu|kể từ ngày",
    "numeric_money_quantity": r"mức phạt|tỷ lệ|phần trăm|đồng|triệu đồng|tỷ đồng|\d+\s*%",
    "legal_citation_lookup": r"theo quy định tại|căn cứ vào|quy định tại điều|luật số|nghị định số",
}
# References that questions and answers hold.
SIGNALS = {
    "article": r"\bĐiều\s+(\d+[A-ZĐ]?)\b", "clause": r"\bKhoản\s+(\d+[A-ZĐ]?)\b", "point": r"\bĐiểm\s+([a-zđ])\b",
    "document_number": r"\b\d+/\d+/(?:NĐ-CP|TT-B\w+|QĐ-UBND|TT-BTC|TT-BYT|TT-BGDĐT|TT-BCA|TT-BLĐTBXH|TT-BCT|TT-BNV|TT-BTNMT|TT-BTP|TT-NHNN|NQ-CP|NQ-HĐND|VBHN-B\w+)\b",
    "document_name": r"\b(?:Luật|Bộ luật|Nghị định|Thông tư|Quyết định|Pháp lệnh|Nghị quyết)\s+(?:số\s+)?[\w\s\d/–\-]{3,40}",
}
ENUMERATED, BULLETS = r"(?m)(?:^\s*\d+\.|\b\d+\.\s+|^\s*[a-zđ]\))", r"(?m)^\s*[-*•]\s+"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iuU)" + pattern)


def qa_signals(df: DataFrame, question: str, answer: str) -> DataFrame:
    """df with `kinds`, `styles` and `signals`, arrays of what each pair shows, and `ratio`, answer to question characters."""
    q, a = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    kinds = F.array_compact(F.array(*[F.when(_has(q, p) | _has(a, p), F.lit(k)) for k, p in TAXONOMY.items()]))
    paragraphs = F.size(F.filter(F.split(a, "\n"), lambda x: x.rlike(r"(?U)\S")))
    short = (F.length(a) < 120) & ~F.contains(F.substr(a, F.lit(1), F.greatest(F.length(a) - 1, F.lit(0))), F.lit("."))
    styles = F.array_compact(F.array(
        F.when(paragraphs > 1, F.lit("multi_paragraph")), F.when(a.rlike("(?U)" + ENUMERATED), F.lit("enumerated_list")), F.when(a.rlike("(?U)" + BULLETS), F.lit("bullet_list")),
        F.when((paragraphs == 1) & short, F.lit("single_short_sentence")).when(paragraphs == 1, F.lit("multi_sentence_prose")),
    ))
    sides = [F.when(_has(t, p), F.lit(f"{side}_has_{k}")) for side, t in (("q", q), ("a", a)) for k, p in SIGNALS.items()]
    both = [F.when(_has(q, SIGNALS["article"]) & _has(a, SIGNALS["article"]), F.lit("both_have_article")), F.when(_has(q, SIGNALS["article"]) | _has(a, SIGNALS["article"]), F.lit("either_has_article"))]
    ratio = F.when(F.length(q) > 0, F.length(a) / F.length(q)).otherwise(F.lit(0.0))
    return df.withColumns({"kinds": kinds, "styles": styles, "signals": F.array_compact(F.array(*sides, *both)), "ratio": ratio})


def qa_census(df: DataFrame, question: str, answer: str) -> DataFrame:
    """(dimension, value, n): how many pairs show each kind, style and signal; what none shows has no row."""
    s = qa_signals(df, question, answer)

    def named(c: str) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(c).alias("dimension"), v.alias("value")))

    tall = s.select(F.explode(F.concat(*map(named, ("kinds", "styles", "signals")))).alias("x"))
    return tall.select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def qa_lengths(df: DataFrame, question: str, answer: str) -> DataFrame:
    """One row: characters and words of questions and answers, and their ratio: mean, median, 95th percentile, maximum."""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    chars = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    m = qa_signals(df, question, answer).select(chars(question).alias("q_chars"), words(question).alias("q_words"), chars(answer).alias("a_chars"), words(answer).alias("a_words"), "ratio")
    four = lambda c: [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.expr(f"percentile({c}, 0.5)"), 6).alias(f"{c}_p50"), F.round(F.expr(f"percentile({c}, 0.95)"), 6).alias(f"{c}_p95"), F.round(F.max(c).cast("double"), 6).alias(f"{c}_max")]
    return m.agg(F.count("*").alias("pairs"), *[x for c in m.columns for x in four(c)])


def eligible_records(records: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """records(question_id, stop_reason, is_valid, n_evidence, n_trace, claims) that were verified with evidence, trace and claims, less the excluded ids."""
    good = records.where((F.col("stop_reason") == "answer_verified") & F.col("is_valid") & (F.col("n_evidence") > 0) & (F.col("n_trace") > 0) & (F.size("claims") > 0))
    return good if excluded is None else good.join(excluded.select("question_id"), "question_id", "left_anti")


def control_strata(records: DataFrame) -> DataFrame:
    """records with `stratum`: negation before numeric before several clean claims before one; null where none fits.

    claims: array<struct<has_negation, negation_match, has_number, numeric_match>>.
    """
    any_of = lambda f: F.exists("claims", f)
    clean = ~any_of(lambda c: ~F.coalesce(c["numeric_match"], F.lit(True)) | ~F.coalesce(c["negation_match"], F.lit(True)))
    stratum = (
        F.when(any_of(lambda c: c["has_negation"] & F.coalesce(c["negation_match"], F.lit(False))), F.lit("negation"))
        .when(any_of(lambda c: c["has_number"] & F.coalesce(c["numeric_match"], F.lit(False))), F.lit("numeric"))
        .when((F.size("claims") >= 2) & clean, F.lit("multi_claim_clean")).when((F.size("claims") == 1) & clean, F.lit("single_claim_clean"))
    )
    return records.withColumn("stratum", stratum)


def choose_controls(records: DataFrame, primary: int, reserve: int, salt: str) -> DataFrame:
    """(question_id, stratum, place, role): salted-hash quota of each stratum. Records without a stratum, and strata with too few, are refused."""
    marked = control_strata(records)
    if bad := marked.where("stratum is null").limit(5).collect():
        raise ValueError(f"no stratum for {[r.question_id for r in bad]}")
    sizes = marked.groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") < primary + reserve)
    if few := sizes.collect():  # four strata at most
        raise ValueError(f"too few records in {sorted(r.stratum for r in few)}")
    return stratified_sample(marked, "question_id", "stratum", primary, reserve, salt)


def packets(chosen: DataFrame, questions: DataFrame, evidence: DataFrame, chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a chosen question: its text, evidence with the chunks' texts, and replayed claims; parts that are missing show in `problems`.

    questions(question_id, question), evidence(question_id, evidence_id, chunk_id), chunks(chunk_id, text), claims(question_id, claim_id, claim_text, supported).
    """
    wanted = evidence.join(chosen.select("question_id"), "question_id", "left_semi")
    ev = wanted.join(chunks, "chunk_id", "left").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "chunk_id", "text"))).alias("evidence"))
    cl = claims.join(chosen.select("question_id"), "question_id", "left_semi").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim_text", "supported"))).alias("claims"))
    out = chosen.join(questions, "question_id", "left").join(ev, "question_id", "left").join(cl, "question_id", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("question").isNull(), F.lit("missing_question")), F.when(F.col("evidence").isNull(), F.lit("missing_evidence")),
        F.when(F.exists("evidence", lambda e: e["text"].isNull()), F.lit("missing_chunk")), F.when(F.col("claims").isNull(), F.lit("missing_claims")),
    ))
    return out.withColumn("problems", problems)


def over_length(df: DataFrame, id_col: str, count: Column, most: int) -> DataFrame:
    """(id, tokens) of items beyond `most` tokens; `count` is any tokenizer's count as a column."""
    return df.select(id_col, count.alias("tokens")).where(F.col("tokens") > most)
