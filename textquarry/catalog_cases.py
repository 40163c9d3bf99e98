"""Queries whose inputs are cases worked out by hand, dealt over a whole table: every branch of an operator has rows, and the SQL holds the expected values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.catalog import _query
from textquarry.operators import chunking, cleaning, evidence, parsing, verdicts
from textquarry.session import table


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _values(cases: list[tuple], names: str) -> str:
    """A SQL table of cases: k is the place of a case, the other columns are its expected values."""
    rows = ", ".join("(" + ", ".join([str(i), *map(_literal, c)]) + ")" for i, c in enumerate(cases))
    return f"x AS (SELECT * FROM (VALUES {rows}) AS t(k, {names}))"


def _dealt(spark, sf: str, name: str, key: str, texts: list[str | None]) -> DataFrame:
    """(key, text): each row of a table with one of the texts, by its key."""
    text = F.element_at(F.array(*[F.lit(t).cast("string") for t in texts]), (F.col(key) % len(texts) + 1).cast("int"))
    return table(spark, sf, name).select(key, text.alias("text"))


# --- cleaning ---------------------------------------------------------------------------------------

_HTML = [
    ('<nav>x</nav><p hidden>y</p><div style="display: none">z</div><p>Giữ lại</p><table><tr><td>A</td><td>B</td></tr></table>', "Giữ lại\nA | B", None),
    ("<p>một</p><p>hai<br>ba</p><script>var a = '<p>';</script>bốn", "một\nhai\nba\nbốn", None),
    ("<div aria-hidden='TRUE'>a<div>b</div>c</div>d &amp; e&nbsp;f", "d & e f", None),
    ("<tr><th>1</th><td>2</td></tr><tr><td>3</td></tr><img hidden>x", "1 | 2\n3\nx", None),
    ("<p class='Sidebar x'>gone</p><p class='sidebars'>stays</p>", "stays", None),
    ("<style>p{}</style><nav>only</nav>", "", "empty_after_cleaning"),
    ("  ", "", "missing_html"),
    (None, None, "missing_html"),
    ("<ul><li>a<li>b</ul>\n\n\n\n<p>c</p>", "a\nb\n\nc", None),
]


@_query(f"WITH {_values([c[1:] for c in _HTML], 'clean_text, issue')} SELECT page_id, clean_text, issue FROM pages JOIN x ON k = page_id % {len(_HTML)}")
def html_cleaning_cases(spark, sf):
    return cleaning.clean_documents(_dealt(spark, sf, "pages", "page_id", [c[0] for c in _HTML]), "text").select("page_id", "clean_text", "issue")


_PASSAGES = [
    ("Theo <dự thảo> này\nfunction ShowGuid(a) { chưa đóng\ncòn  đây", "Theo <dự thảo> này\nfunction ShowGuid(a) { chưa đóng\ncòn  đây", 0, False, False),
    ('A<br>B <img alt="ảnh" src="x">\nfunction ShowGuid(a) {\n var s = "}"; // }\n}\nHỏi đáp pháp luật\nvar breadcrumbs = 1\nC.....  Thông báo', "A\nB ảnh\nC", 1, True, True),
    ("Hỏi đáp pháp luật", "Hỏi đáp pháp luật", 0, False, False),
    ("<p>x</p><option>bỏ</option>y &lt; z", "x\ny < z", 0, False, True),
    (None, None, 0, False, False),
]


@_query(f"WITH {_values([c[1:] for c in _PASSAGES], 'text, boilerplate, script, markup')} SELECT page_id, text, boilerplate::INT AS boilerplate, script, markup FROM pages JOIN x ON k = page_id % {len(_PASSAGES)}")
def passage_cleaning_cases(spark, sf):
    return cleaning.clean_passages(_dealt(spark, sf, "pages", "page_id", [c[0] for c in _PASSAGES]), "text", ("Thông báo",)).select("page_id", "cleaned.*")


# --- hierarchy and chunks ------------------------------------------------------------------------------

_LAWS = [
    (
        "Chương II\nNHỮNG QUY TẮC MẪU\nĐiều 7. Giờ mở cửa thư viện\n1. Thư viện mở cửa lúc 8 giờ.\na) Ngày thường;\nb) Cuối tuần.\n2.5 là số thập phân nên không phải khoản.\nĐiều 8\nThẻ bạn đọc\nLoại thẻ | Lệ phí\nThường | 20.000 đồng\nPhụ lục III",
        "chapter:II,article:7,clause:1,point:a,point:b,article:8,table:,appendix:III",
    ),
    ("Điều 1. Phạm vi\n1. Một.\n2. Hai.\nĐiều 2. Đối tượng", "article:1,clause:1,clause:2,article:2"),
]


@_query(f"WITH {_values([(c[1],) for c in _LAWS], 'blocks')}, y AS (SELECT doc_id, string_split(blocks, ',') AS b FROM documents JOIN x ON k = doc_id % {len(_LAWS)}) SELECT doc_id::VARCHAR AS document_id, (i - 1)::INT AS order_index, split_part(b[i], ':', 1) AS block_type, nullif(split_part(b[i], ':', 2), '') AS block_number FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM y)")
def structure_cases(spark, sf):
    blocks = parsing.parse_documents(_dealt(spark, sf, "documents", "doc_id", [c[0] for c in _LAWS]), "doc_id", "text")
    return blocks.select(F.col("document_id").cast("string").alias("document_id"), F.col("order_index").cast("int").alias("order_index"), "block_type", "block_number")


@_query(r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, n AS tokens, CASE WHEN n = 0 THEN 0 WHEN n <= 100 THEN 1 ELSE 1 + ceil((n - 100) / 90)::BIGINT END AS windows, least(n, 100) AS first_window FROM t""")
def token_windows(spark, sf):
    """Sliding windows of 100 tokens, ten shared: how many each text gives."""
    @F.pandas_udf("tokens long, windows long, first_window long")
    def cut(s: pd.Series) -> pd.DataFrame:
        def sizes(t: str) -> tuple[int, int, int]:  # a text's windows go before the next one's are cut
            w = chunking.split_tokens(t, 100, 10)
            return chunking.count_tokens(t), len(w), chunking.count_tokens(w[0]) if w else 0

        return pd.DataFrame([sizes(t) for t in s], columns=["tokens", "windows", "first_window"])

    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", cut("text").alias("w")).select("doc_id", "w.*")


# --- claims and answers ----------------------------------------------------------------------------------

# Answers with their cited evidence, and each claim's marks and errors.
_EVIDENCE = {"E1": "Thời hạn nộp hồ sơ là 10 ngày làm việc", "E2": "Người lao động không được nghỉ thêm"}
_CLAIMS = [
    ("Thời hạn nộp hồ sơ là 10 ngày [E1].", ["E1"], "C1||"),
    ("Thời hạn nộp hồ sơ là 12 ngày [E1].", ["E1"], "C1|numeric_mismatch|"),
    ("Thời hạn không nộp hồ sơ là 10 ngày [E1]. Người lao động không được nghỉ [E2].", ["E1", "E2"], "C1|negation_mismatch|;C2||"),
    ("Thời hạn nộp hồ sơ.\nHoàn toàn khác biệt xa lạ [E1].", ["E1"], "C1|missing_inline_evidence,no_linked_evidence|;C2|insufficient_lexical_support|"),
    ("Thời hạn nộp hồ sơ [E2]. Thời hạn nộp hồ sơ [E9].", ["E1"], "C1|answer_marker_missing_citation,no_linked_evidence|E1;C2|unknown_evidence_marker,answer_marker_missing_citation,no_linked_evidence|E1"),
]
_CLAIM_ROWS = [(i, *c.split("|")[:2]) for i, case in enumerate(_CLAIMS) for c in case[2].split(";")]


@_query("WITH x AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{e}')" for i, c, e in _CLAIM_ROWS) + f") AS t(k, claim_id, errors)) SELECT doc_id::VARCHAR AS question_id, claim_id, errors, errors = '' AS supported FROM documents JOIN x ON k = doc_id % {len(_CLAIMS)}")
def claim_cases(spark, sf):
    docs = _dealt(spark, sf, "documents", "doc_id", [c[0] for c in _CLAIMS])
    cited = F.element_at(F.array(*[F.array(*map(F.lit, c[1])) for c in _CLAIMS]), (F.col("doc_id") % len(_CLAIMS) + 1).cast("int"))
    key = F.col("doc_id").cast("string").alias("question_id")
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("evidence_id"), F.lit(v).alias("text")) for k, v in _EVIDENCE.items()]))
    found = evidence.verify_claims(docs.select(key, F.col("text").alias("answer"), cited.alias("citation_ids")), docs.select(key, items.alias("e")).select("question_id", "e.*"))
    return found.select("question_id", "claim_id", F.array_join("errors", ",").alias("errors"), "supported")


_GOOD = {"insufficient_evidence": False, "claims": [{"text": "a", "evidence_ids": ["E1"]}], "warnings": []}
_ANSWERS = [
    (json.dumps(_GOOD), "valid", ""),
    (json.dumps({**_GOOD, "x": 1}), "recovered", "removed_extra_fields"),
    (json.dumps({**_GOOD, "claims": {"text": "a", "evidence_ids": "E1", "y": 2}, "warnings": ["w", "w"]}), "recovered", "wrapped_claim,removed_claim_fields,wrapped_evidence_id,deduplicated_warnings"),
    (json.dumps({**_GOOD, "claims": [{"text": "a", "evidence_ids": ["E1", "E2", "E1"]}]}), "recovered", "deduplicated_evidence_ids"),
    (json.dumps({**_GOOD, "claims": [{"text": str(i), "evidence_ids": ["E1"]} for i in range(25)]}), "recovered", "dropped_excess_claims"),
    (json.dumps({**_GOOD, "insufficient_evidence": True}), "failed", ""),
    (json.dumps({**_GOOD, "claims": [{"text": "a", "evidence_ids": ["E01"]}], "z": 0}), "failed", "removed_extra_fields"),
    ("[1]", "failed", ""), ("{", "failed", ""), (None, "failed", ""),
    (json.dumps({"insufficient_evidence": True, "claims": [], "warnings": ["w"]}), "valid", ""),
]


@_query(f"WITH {_values([c[1:] for c in _ANSWERS], 'outcome, repairs')} SELECT event_id, outcome, repairs FROM events JOIN x ON k = event_id % {len(_ANSWERS)}")
def answer_recovery(spark, sf):
    rows = _dealt(spark, sf, "events", "event_id", [c[0] for c in _ANSWERS]).select("event_id", verdicts.recover_answers(F.col("text")).alias("r"))
    return rows.select("event_id", "r.outcome", F.array_join("r.repairs", ",").alias("repairs"))

