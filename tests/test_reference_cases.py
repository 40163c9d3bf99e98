"""Literal cases of the operators, with expected values worked out by hand."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.operators import analytics, bm25, chunking, cleaning, dataset, evidence, fusion, graph, metrics, parsing, query, vectors
from textquarry.sources import json_sources as js


def test_meteor_and_rouge_of_a_permutation(spark):
    df = spark.createDataFrame([(1, "a c b", "a b c"), (2, "", "a"), (3, "x y", "x y")], "id int, p string, r string")
    got = {r.id: r.meteor for r in metrics.meteor(df, "id", "p", "r").collect()}
    assert got[1] == pytest.approx(0.5) and got[2] == 0 and got[3] == pytest.approx(1 - 0.5 / 8)
    t = lambda c: metrics.metric_tokens(F.col(c))
    rows = df.select("id", metrics.rouge_l(t("p"), t("r")).alias("fold"), metrics.rouge_l_long(t("p"), t("r")).alias("bits")).collect()
    for r in rows:
        assert r.fold == pytest.approx(r.bits) and r.fold == pytest.approx({1: 2 / 3, 2: 0, 3: 1}[r.id])


def test_ndcg_of_a_relevant_item_ranked_second(spark):
    hits = spark.createDataFrame([(1, "low", 1), (1, "top", 2), (1, "low", 3)], "case_id int, target_id string, rank int")
    grades = spark.createDataFrame([(1, "low", 1), (1, "top", 3)], "case_id int, target_id string, grade int")
    (r,) = metrics.ranking_metrics(hits, grades, [1]).collect()
    assert r.ndcg == pytest.approx(1 / 7) and r.recall == 0.5 and r.precision == 1 and r.reciprocal_rank == 1


def test_fusion_scores_and_order(spark):
    a = spark.createDataFrame([(1, "x", 1, 9.0)], "query_id int, chunk_id string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 0.9), (1, "x", 2, 0.8)], "query_id int, chunk_id string, rank int, score double")
    rows = fusion.reciprocal_rank_fusion(a, b).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["x", "y"] and rows[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-11)
    assert fusion.rerank_problems(a.withColumn("rank", F.lit(2)), b).count() == 1
    assert fusion.fusion_conflicts(a.union(a)).count() == 2


def test_bm25_common_term_still_matches(spark):
    docs = spark.createDataFrame([(1, "luật nhà"), (2, "luật đất"), (3, "luật")], "id int, t string")
    q = spark.createDataFrame([(9, "luật")], "q int, t string")
    index = bm25.build_index(docs, "id", "t")
    hits = bm25.search(bm25.plan_queries(q, index, "q", "t"), index).collect()
    assert {h.chunk_id for h in hits} == {1, 2, 3} and all(0 < h.score < 1e-5 for h in hits)
    none = spark.createDataFrame([(9, "!!"), (8, "zzz")], "q int, t string")
    planned = bm25.plan_queries(none, index, "q", "t")
    w = {r.query_id: r.warnings for r in bm25.warnings(none, planned, bm25.search(planned, index), "q", "t").collect()}
    assert w == {9: ["query_has_no_indexable_terms"], 8: ["no_bm25_matches"]}


def test_planner_keeps_numbers_and_order(spark):
    words = [f"w{chr(97 + i)}" for i in range(11)]
    docs = spark.createDataFrame([(i, " ".join([w] * 1)) for i, w in enumerate(words)] + [(99, "2020")] + [(100 + i, "x") for i in range(40)], "id int, t string")
    q = spark.createDataFrame([(1, " ".join([*words, "2020"]))], "q int, t string")
    rows = bm25.plan_queries(q, bm25.build_index(docs, "id", "t"), "q", "t").orderBy("pos").collect()
    assert [r.term for r in rows] == [*words[:7], "2020"]


def test_greedy_budget_lets_a_smaller_item_in(spark):
    rows = [(1, c, "d", i + 1, n) for i, (c, n) in enumerate([("a", 60), ("b", 50), ("c", 30)])]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, document_id string, selection_order int, token_count int")
    got = {r.chunk_id: (r.reason, r.selection_rank) for r in evidence.select_within_budget(df, 8, 100).collect()}
    assert got == {"a": ("selected", 1), "b": ("token_budget", None), "c": ("selected", 2)}


def test_claims_and_grounding(spark):
    text = "Thời hạn nộp hồ sơ là 10 ngày làm việc [E1]. Không áp dụng cho tổ chức [E1]. [E1]\nKhông có dấu."
    answers = spark.createDataFrame([("q", text, ["E1", "E2"])], "question_id string, answer string, citation_ids array<string>")
    ev = spark.createDataFrame([("q", "E1", "Thời hạn nộp hồ sơ là 12 ngày làm việc, áp dụng cho tổ chức")], "question_id string, evidence_id string, text string")
    claims = evidence.verify_claims(answers, ev)
    got = {r.claim_id: r.errors for r in claims.collect()}
    assert got["C1"] == ["numeric_mismatch"] and got["C2"] == ["negation_mismatch"] and "missing_inline_evidence" in got["C3"]
    assert [r.evidence_id for r in evidence.unused_citations(answers, claims).collect()] == ["E2"]
    gates = evidence.repair_gates(claims).first()
    assert not gates.can_repair and not gates.can_salvage
    ok = claims.withColumn("supported", F.col("claim_id") == "C1")
    assert evidence.salvage_claims(ok).first().answer == "Thời hạn nộp hồ sơ là 10 ngày làm việc [E1]."


def test_applicability_precedence(spark):
    df = spark.createDataFrame([(True, True, None, "x"), (False, True, None, "x"), (False, True, False, "x"), (False, None, None, None), (False, None, None, "x")], "i boolean, d boolean, a boolean, s string")
    got = [r[0] for r in df.select(evidence.applicability(F.col("i"), F.col("d"), F.col("a"), F.col("s"))).collect()]
    assert got == ["inactive", "explicit_match", "reference_mismatch", "unknown", "compatible"]


def test_bfs_two_hops(spark):
    e = spark.createDataFrame([("A", "B", None, "r"), ("A", "C", None, "r"), ("B", "C", None, "r"), ("C", "D", None, "r"), ("D", "E", None, "r")], "source string, target string, kind string, raw string")
    seeds = spark.createDataFrame([("s", "A", 1)], "seed_set string, id string, pos int")
    got = {(r.source, r.target, r.hop, len(r.path)) for r in graph.traverse(e, seeds).collect()}
    assert got == {("A", "B", 1, 1), ("A", "C", 1, 1), ("C", "D", 2, 2)}
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "id string")
    assert graph.edge_problems(e, nodes).count() == 1


def test_query_understanding(spark):
    q = "Xin hỏi, theo Điều 5 khoản 2 thì mức phạt bao nhiêu?"
    df = spark.createDataFrame([(1, q), (2, None), (3, "Nghị định 01/2020/NĐ-CP sửa đổi gì năm 2021")], "id int, question string")
    rows = {r.id: r for r in query.analyze(df).collect()}
    assert rows[1].article_numbers == ["5"] and rows[1].clause_numbers == ["2"] and rows[1].intent == "quantitative"
    assert rows[2].intent == "general" and rows[3].intent == "relationship" and rows[3].document_numbers == ["01/2020/NĐ-CP"] and rows[3].year_mentions == ["2020", "2021"]
    v = query.plan_variants(df.where("id = 1"), "id").orderBy("variant_id").collect()
    assert [(r.kind, r.text) for r in v] == [("normalized", q), ("framing_stripped", q[9:]), ("legal_reference", "Điều 5 khoản 2")]
    routes = query.plan_routes(query.analyze(df)).orderBy("id").select("routes").collect()
    assert routes[0][0] == ["hybrid_rerank", "bm25", "hybrid"] and routes[2][0][0] == "relationship_rerank"


def test_split_target_takes_whole_groups(spark):
    g = spark.createDataFrame([(i, i // 3) for i in range(9)], "id int, group_id int")
    parts = dataset.group_split(g, 0.5)
    assert parts.where("part = 'dev'").count() == 6 and parts.groupBy("group_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_duplicate_pairs(spark):
    d = spark.createDataFrame([(1, "Mức phạt?"), (2, "mức  PHẠT"), (3, "mức phạt"), (4, "khác"), (5, None)], "id int, t string")
    (r,) = dataset.exact_groups(d, "id", "t").collect()
    assert (r.n, r.pairs, r.first_id) == (3, 3, 1)
    got = {r.id: r.group_id for r in dataset.duplicate_groups(d, "id", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_nearest_rank_and_pareto(spark):
    (r,) = spark.range(1).select(metrics.nearest_rank(F.array(*[F.lit(x) for x in (4, 1, 3, 2)]), 0.5).alias("p")).collect()
    assert r.p == 3
    c = spark.createDataFrame([("a", 0.9, 10), ("b", 0.8, 5), ("c", 0.8, 12)], "id string, q double, ms int")
    two = {r.id: r.dominated for r in analytics.pareto(c, "id", {"q": "max", "ms": "min"}).collect()}
    three = {r.id: r.dominated for r in analytics.pareto(c.withColumn("z", F.lit(1)), "id", {"q": "max", "ms": "min", "z": "max"}).collect()}
    assert two == three == {"a": False, "b": False, "c": True}
    assert analytics.lexicographic_best(c, {"q": "max", "ms": "min"}, "id").first().id == "a"


def test_sliding_windows():
    t = " ".join("abcdefghij")
    assert chunking.split_tokens(t, 4, 1) == ["a b c d", "d e f g", "g h i j"] and chunking.split_tokens("", 4, 1) == []


LEGAL = """Chương II
NHỮNG QUY TẮC MẪU
Điều 7. Giờ mở cửa thư viện
1. Thư viện mở cửa lúc 8 giờ.
a) Ngày thường;
b) Cuối tuần.
2.5 là số thập phân nên không phải khoản.
Điều 8
Thẻ bạn đọc
Loại thẻ | Lệ phí
Thường | 20.000 đồng
Phụ lục III"""


def test_structure_parser_and_chunks(spark):
    blocks = parsing.document_blocks("d", LEGAL)
    assert [(b["block_type"], b["block_number"]) for b in blocks] == [("chapter", "II"), ("article", "7"), ("clause", "1"), ("point", "a"), ("point", "b"), ("article", "8"), ("table", None), ("appendix", "III")]
    assert blocks[0]["title"] == "NHỮNG QUY TẮC MẪU" and blocks[5]["title"] == "Thẻ bạn đọc" and "2.5" in blocks[4]["text"]
    assert blocks[6]["text"].count(" | ") == 2 and blocks[6]["parent_block_id"] == blocks[5]["block_id"] and blocks[7]["parent_block_id"] is None
    df = spark.createDataFrame([("d", LEGAL), ("n", None), ("e", ""), ("l", "Điều 1. X\n" + "từ " * 900)], "id string, t string")
    docs = df.select(F.col("id").alias("document_id"))
    b, c = parsing.parse_documents(df, "id", "t"), chunking.chunk_documents(df, "id", "t")
    assert chunking.chunk_problems(docs, b, c).count() == 0 and chunking.block_problems(docs, b).count() == 0
    assert {r.document_id: r.issue for r in parsing.parse_diagnostics(df, b, "id", "t").collect()} == {"d": None, "n": "missing_clean_text", "e": "no_legal_structure", "l": None}
    rows = c.where("document_id = 'l'").collect()
    assert len(rows) == math.ceil((903 - 384) / 334) + 1 and all(r.strategy == "token_fallback" and r.token_count <= 384 for r in rows)


def test_html_cleaner():
    html = '<nav>x</nav><p hidden>y</p><div style="display: none">z</div><p>Giữ lại</p><script>var a = "</p>";</script><table><tr><td>A</td><td>B</td></tr></table>'
    assert cleaning.html_to_text(html) == "Giữ lại\nA | B" and cleaning.html_to_text(None) is None and cleaning.html_to_text("") == ""


def test_passage_cleaner_keeps_what_it_does_not_know():
    keep = "Theo <dự thảo> này\nfunction ShowGuid(a) { chưa đóng\ncòn  đây"
    assert cleaning.clean_passage(keep)["text"] == keep
    gone = cleaning.clean_passage('A<br>B <img alt="ảnh" src="x">\nfunction ShowGuid(a) {\n var s = "}"; // }\n}\nHỏi đáp pháp luật\nvar breadcrumbs = 1\nC.....  Thông báo', ("Thông báo",))
    assert gone == {"text": "A\nB ảnh\nC", "boilerplate": 1, "script": True, "markup": True}
    assert cleaning.clean_passage("Hỏi đáp pháp luật")["text"] == "Hỏi đáp pháp luật" and cleaning.clean_passage(None)["text"] is None


def test_cosine_ties_and_invalid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0])], "id int, e array<float>")
    rows = vectors.cosine_top_k(v.where("id = 1"), v, 2, "id", "id", "e").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(1, 1.0), (2, 1.0)]
    assert {r.id for r in vectors.invalid(v, "e").collect()} == {4, 5, 6}


def test_sources(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"b": {"question": "x?", "answer": "y"}, "a": {"question": "z?"}}))
    rows = js.read_questions(spark, str(q)).orderBy("pos").collect()
    assert [(r.question_id, r.reference_answer) for r in rows] == [("b", "y"), ("a", None)]
    with pytest.raises(js.InvalidSource):
        js.read_questions(spark, str(q), require_answers=True)
    q.write_text('{"a": {"question": "1"}, "a": {"question": "2"}}')
    with pytest.raises(js.InvalidSource):
        js.read_questions(spark, str(q))
    for bad in (True, -1, " ", 1.5, None):
        with pytest.raises(js.InvalidSource):
            js.canonical_id(bad)
    z = tmp_path / "c.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/context_2.json", json.dumps({"id": 2, "link": "l", "passage": "p"}))
        f.writestr("d/context_1.json", json.dumps({"id": " a ", "name": "", "link": "l", "passage": "p"}))
    got = js.to_documents(js.read_contexts(spark, str(z)), "s").collect()
    assert {(r.document_id, r.title) for r in got} == {("2", None), ("a", None)}
    with pytest.raises(js.InvalidSource):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as f:
            f.writestr("../context_1.json", "{}")
        list(js.zip_members(b.getvalue()))


def test_artifacts_and_submission(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    p = str(tmp_path / "art")
    js.write_artifact(df, p)
    assert js.read_artifact(spark, p, df.schema).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        js.write_artifact(df, p)
    df.limit(1).write.mode("append").json(p)
    with pytest.raises(js.InvalidSource):
        js.read_artifact(spark, p, df.schema)
    qs = spark.createDataFrame([("b", 0), ("a", 1)], "question_id string, pos int")
    ans = spark.createDataFrame([("a", "1"), ("b", "2")], "question_id string, answer string")
    one = js.submission_zip(ans, qs)
    assert one == js.submission_zip(ans, qs) and [*json.loads(zipfile.ZipFile(io.BytesIO(one)).read("results.json"))] == ["b", "a"]
    with pytest.raises(js.InvalidSource):
        js.submission_zip(ans.limit(1), qs)


def test_dataset_helpers(spark):
    (r,) = spark.range(1).select(*[c.alias(n) for c, n in zip(dataset.sft_encoding(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4), F.lit(5)), 0, 5), "xy")]).collect()
    assert r.x == [1, 2, 3, 4, 0] and r.y == [-100, -100, 3, 4, 0]
    ids = spark.createDataFrame([(1, "header", "A"), (1, "slug", "A"), (2, "slug", "B"), (3, "header", "A"), (3, "slug", "B"), (4, "slug", None)], "document_id int, source string, value string")
    assert {r.document_id: r.status for r in dataset.resolve_identity(ids).collect()} == {1: "strict", 2: "provisional", 3: "ambiguous", 4: "unresolved"}
    (s,) = spark.createDataFrame([("Nghị định Số 01/2020/NĐ-CP",)], "t string").select(dataset.slug(F.col("t"))).collect()
    assert s[0] == "nghi-dinh-so-01-2020-nd-cp"
    b = spark.createDataFrame([("m", i, 0.1 * i) for i in range(20)], "g string, i int, d double")
    (r,) = analytics.bootstrap_interval(b, "g", "i", "d").collect()
    assert r.low < r.mean < r.high and r.n == 20


def test_resumable_answers(spark, tmp_path):
    from textquarry.streaming.ingest import ingest_chunks, resume_answers

    q = spark.createDataFrame([("a",), ("b",)], "question_id string")
    p = str(tmp_path / "out")
    answer = lambda d: d.withColumn("answer", F.lit("x"))
    assert resume_answers(q.limit(1), p, answer) == 1 and resume_answers(q, p, answer) == 1 and resume_answers(q, p, answer) == 0
    src = str(tmp_path / "src")
    spark.createDataFrame([("d", LEGAL)], "id string, t string").write.parquet(src)
    for _ in range(2):
        ingest_chunks(spark, src, "id string, t string", str(tmp_path / "chunks"), str(tmp_path / "cp"), "id", "t").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == len(chunking.chunk_document("d", None, parsing.document_blocks("d", LEGAL)))


def test_components_of_all_lines_as_union_find(spark, tmp_path):
    from textquarry import catalog

    lines = [(1, 1, 50), (1, 2, 3), (2, 2, 7), (3, 3, 1), (4, 3, 50), (5, 4, 49), (6, 5, 50), (6, 5, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for order, supplier, _ in lines:
        a, b = sorted((find(order), find(-1 - supplier)))
        up[b] = a
    got = {r.id: r.component for r in catalog.queries()["components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in up} and len(got) == 11 and "components" not in catalog.oracle_sql()
