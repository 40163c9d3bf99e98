"""Query understanding as expressions over a question column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import ordered_distinct_folded

# Patterns and cues of Vietnamese legal questions.
DOCUMENT_NUMBER = r"(?<!\w)\d{1,4}/\d{4}/[0-9A-ZĐ-]+(?:/[0-9A-ZĐ-]+)*(?!\w)"
ARTICLE = r"\bđiều\s+(\d+[a-zđ]?)\b"
CLAUSE = r"\bkhoản\s+(\d+[a-zđ]?)\b"
POINT = r"\bđiểm\s+([a-zđ]|\d+)\b"
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
RELATIONSHIP_CUES = ("sửa đổi", "bổ sung", "thay thế", "bãi bỏ", "hướng dẫn", "dẫn chiếu", "còn hiệu lực", "hết hiệu lực")
SCOPE_CUES = ("đối với", "áp dụng cho", "không áp dụng", "trong trường hợp", "trừ trường hợp", "ngoại trừ")
INTENT_CUES = (
    ("definition", ("là gì", "được hiểu là", "định nghĩa")),
    ("procedure", ("thủ tục", "hồ sơ", "trình tự")),
    ("quantitative", ("bao nhiêu", "mức nào", "thời hạn", "bao lâu")),
    ("eligibility", ("có được", "được phép", "đủ điều kiện")),
    ("prohibition", ("bị cấm", "có bị cấm", "không được")),
    ("obligation", ("có phải", "bắt buộc", "phải")),
)
FRAMING = (
    r"xin\s+(?:cho\s+)?hỏi[\s,:;\-–—]+",
    r"cho\s+(?:tôi|mình|em)\s+hỏi[\s,:;\-–—]+",
    r"tôi\s+muốn\s+hỏi[\s,:;\-–—]+",
    r"theo\s+quy\s+định\s+(?:của\s+)?pháp\s+luật(?:\s+hiện\s+hành)?[\s,:;\-–—]+",
)
FLAGS = "(?iuU)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return ordered_distinct_folded(F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(group)))


def _cues(folded: Column, cues: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(folded, c))


def _has_any(folded: Column, cues: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for c in cues:
        found = found | F.contains(folded, F.lit(c))
    return found


def analyze(df: DataFrame, question_col: str = "question") -> DataFrame:
    """Adds the question trimmed, its references, years, cues and intent; a null question counts as empty."""
    q = F.trim(F.coalesce(F.col(question_col), F.lit("")))
    df = df.withColumn("normalized", q).withColumn("__f", F.lower(q))
    t, f = F.col("normalized"), F.col("__f")
    df = df.withColumns({
        "document_numbers": _all(t, DOCUMENT_NUMBER, 0), "article_numbers": _all(t, ARTICLE, 1), "clause_numbers": _all(t, CLAUSE, 1), "point_numbers": _all(t, POINT, 1),
        "year_mentions": _all(t, YEAR, 0), "relationship_cues": _cues(f, RELATIONSHIP_CUES), "scope_cues": _cues(f, SCOPE_CUES),
    })
    has_reference = F.size(F.concat("document_numbers", "article_numbers", "clause_numbers", "point_numbers")) > 0
    intent = F.when(F.size("relationship_cues") > 0, F.lit("relationship"))
    for name, cues in INTENT_CUES:
        intent = intent.when(_has_any(f, cues), F.lit(name))
    intent = intent.when(has_reference, F.lit("reference_lookup")).otherwise(F.lit("general"))
    return df.withColumn("has_reference", has_reference).withColumn("intent", intent).drop("__f")


def strip_framing(question: Column) -> Column:
    """Without the polite or framing beginnings, however many stand there."""
    return F.trim(F.regexp_replace(F.trim(question), FLAGS + "^(?:" + "|".join(FRAMING) + ")+", ""))


def reference_variant(question: Column) -> Column:
    """All references in order, each once, joined by a space; null if there are none or nothing else."""
    any_of = "|".join(f"(?:{p})" for p in (DOCUMENT_NUMBER, ARTICLE, CLAUSE, POINT))
    joined = F.array_join(ordered_distinct_folded(F.regexp_extract_all(question, F.lit(FLAGS + any_of), F.lit(0))), " ")
    return F.when((joined != "") & (F.lower(joined) != F.lower(question)), joined)


def plan_variants(df: DataFrame, id_col: str, question_col: str = "question", max_variants: int = 3) -> DataFrame:
    """(query_id, variant_id, kind, text): the question, without framing, and its references only; equal ones once."""
    q = F.trim(F.coalesce(F.col(question_col), F.lit("")))
    forms = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in (("normalized", q), ("framing_stripped", strip_framing(q)), ("legal_reference", reference_variant(q)))])
    tall = df.select(F.col(id_col).alias("query_id"), F.posexplode(forms)).select("query_id", "pos", "col.kind", "col.text").where("text is not null and text <> ''")
    once = tall.withColumn("same", F.row_number().over(Window.partitionBy("query_id", F.lower("text")).orderBy("pos"))).where("same = 1")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return once.withColumn("n", n).where(F.col("n") <= max_variants).select("query_id", F.concat(F.lit("qv"), "n").alias("variant_id"), "kind", "text")


def next_rewrite(variants: DataFrame, used: DataFrame) -> DataFrame:
    """(query_id, text): the first variant that a query has not used; used(query_id, text)."""
    left = variants.join(used.select("query_id", F.lower("text").alias("__u")), (variants["query_id"] == used["query_id"]) & (F.lower(variants["text"]) == F.col("__u")), "left_anti")
    return left.groupBy("query_id").agg(F.min_by("text", "variant_id").alias("text"))


def plan_routes(df: DataFrame, max_retry: int = 2, default_order: tuple[str, ...] = ("hybrid_rerank", "hybrid", "bm25", "dense")) -> DataFrame:
    """Adds `routes`: the ordered, distinct searches an analysed question tries, at most max_retry + 1."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    adaptive = (
        F.when(F.col("intent") == "relationship", lit(("relationship_rerank", "hybrid_rerank", "hybrid")))
        .when(F.col("has_reference") | (F.col("intent") == "quantitative"), lit(("hybrid_rerank", "bm25", "hybrid")))
        .otherwise(F.array().cast("array<string>"))
    )
    return df.withColumn("routes", F.slice(F.array_distinct(F.concat(adaptive, lit(default_order))), 1, max_retry + 1))


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def create_queries(df: DataFrame, max_chars: int = 2000, top_k: int = 10, candidate_k: int = 20, max_top_k: int = 50, max_candidate_k: int = 100) -> tuple[DataFrame, DataFrame]:
    """Accepted queries and refused ones with their `problem`, of df(query_id, question) and optionally top_k and candidate_k.

    The original question is trimmed; the normalised one is in form C with single spaces.
    """
    q = F.regexp_replace(F.coalesce("question", F.lit("")), r"(?U)^\s+|\s+$", "")
    k = F.coalesce(F.col("top_k"), F.lit(top_k)) if "top_k" in df.columns else F.lit(top_k)
    c = F.coalesce(F.col("candidate_k"), F.lit(candidate_k)) if "candidate_k" in df.columns else F.lit(candidate_k)
    rows = df.select("query_id", q.alias("original_question"), _composed(F.regexp_replace(q, r"(?U)\s+", " ")).alias("normalized_question"), k.cast("int").alias("top_k"), c.cast("int").alias("candidate_k"))
    problem = (
        F.when(F.col("query_id").isNull() | (F.trim(F.col("query_id").cast("string")) == ""), F.lit("query_id")).when(F.col("original_question") == "", F.lit("blank_question"))
        .when(F.length("original_question") > max_chars, F.lit("question_too_long"))
        .when((F.col("top_k") < 1) | (F.col("top_k") > max_top_k) | (F.col("candidate_k") > max_candidate_k) | (F.col("candidate_k") < F.col("top_k")), F.lit("limits"))
    )
    marked = rows.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null").select("query_id", "problem")
