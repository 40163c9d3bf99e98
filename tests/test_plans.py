"""Search strategies, vector artifacts, the answer loop, identities, gates and censuses on small tables."""

import pytest
from pyspark.sql import functions as F

from textquarry.operators import bm25, census, gates, identity, query, vectors
from textquarry.plans import agent, retrieval

TEXTS = [(1, "luật đất đai quy định thuê đất"), (2, "nghị định về xử phạt giao thông"), (3, "thuê nhà và thuê đất ở đô thị"), (4, None), (5, "")]
PROVIDER = {"provider": "hashing", "version": "1", "model": "md5", "revision": "1", "dimension": 32}


def embed(df, text):
    return vectors.hashing_embedder(df, text, 32)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(TEXTS, "chunk_id int, text string")
    return retrieval.Corpus(bm25.build_index(docs, "chunk_id", "text"), embed(docs, "text").select("chunk_id", "embedding"), docs, embed)


def test_embedding_is_that_of_the_digests(spark):
    import hashlib

    (r,) = embed(spark.createDataFrame([("Đất, đất nhà!",)], "t string"), "t").collect()
    want = [0.0] * 32
    for w in ("đất", "đất", "nhà"):
        h = hashlib.md5(w.encode()).hexdigest()
        want[int(h[:8], 16) % 32] += -1.0 if int(h[8], 16) % 2 else 1.0
    assert list(r.embedding) == want
    assert embed(spark.createDataFrame([(None,), ("?!",)], "t string"), "t").where("embedding is not null").count() == 0


def test_strategies_are_views_of_one_run(spark, corpus):
    q = spark.createDataFrame([(1, "thuê đất", None), (2, "giao thông", None), (3, "gì đó", "xử phạt"), (4, "", None)], "query_id int, question string, rewritten string")
    limits = retrieval.Limits(top_k=2, candidate_k=3, fusion_k=20)
    assert retrieval.seed_pool(limits) == 2 and retrieval.seed_pool(retrieval.Limits(candidate_k=1)) == 1
    got = {(r.query_id, r.strategy): [] for r in retrieval.search(q, corpus, retrieval.STRATEGIES, limits).collect()}
    for r in retrieval.search(q, corpus, retrieval.STRATEGIES, limits).orderBy("rank").collect():
        got[r.query_id, r.strategy].append(r.chunk_id)
    assert got[2, "bm25"] == [2] and got[3, "bm25"] == [2] and got[2, "hybrid_rerank"][0] == 2 and set(got[1, "bm25"]) == {1, 3}
    assert (4, "bm25") not in got and all(len(v) <= 2 for v in got.values()) and {s for _, s in got} == {*retrieval.STRATEGIES}
    assert {r.variant_id for r in retrieval.active_variants(q, True).where("query_id = 3").collect()} == {"qv-active"}
    with pytest.raises(ValueError):
        retrieval.search(q, corpus, ("telepathy",), limits)
    with pytest.raises(ValueError):
        retrieval.search(q, corpus, ("hybrid_rerank",), retrieval.Limits(candidate_k=500))
    assert retrieval.search(q.limit(0), corpus, ("hybrid", "dense"), limits).count() == 0


def test_vector_index_resumes_and_is_checked(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"từ {i} và {i % 7}") for i in range(60)], "id int, text string")
    path, source = f"file://{tmp_path}/index", {"artifact": "chunks", "version": "1", "sha256": "x"}
    index = vectors.build_vector_index(docs, embed, "id", "text", path, PROVIDER, source, buckets=4)
    first = {r.chunk_id: (tuple(r.embedding), r.bucket) for r in index.table(spark).collect()}
    assert len(first) == 60 and index.manifest["records"] == 60
    import shutil

    shutil.rmtree(tmp_path / "index" / "vectors" / "bucket=2")  # as a stopped build leaves it
    calls = []
    vectors.build_vector_index(docs, lambda d, t: calls.append(d.count()) or embed(d, t), "id", "text", path, PROVIDER, source, buckets=4)
    assert calls == [sum(b == 2 for _, b in first.values())]
    again = vectors.open_vector_index(spark, path, PROVIDER).table(spark)
    assert {r.chunk_id: (tuple(r.embedding), r.bucket) for r in again.collect()} == first
    assert vectors.vector_problems(again, docs, "id", 32).count() == 0
    bad = again.select("chunk_id", F.when(F.col("chunk_id") == 3, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")).alias("embedding")).where("chunk_id <> 5").union(spark.createDataFrame([(99, [0.0] * 32), (7, [1.0])], "chunk_id int, embedding array<float>"))
    assert {tuple(r) for r in vectors.vector_problems(bad, docs, "id", 32).collect()} == {(3, "not_normalised"), (99, "not_finite_or_zero"), (99, "unknown_chunk"), (7, "dimension"), (7, "duplicate_id"), (5, "missing_vector")}
    with pytest.raises(ValueError):
        vectors.open_vector_index(spark, path, PROVIDER | {"dimension": 64})
    with pytest.raises(ValueError):
        vectors.build_vector_index(docs, embed, "id", "text", path, PROVIDER | {"model": "other"}, source, buckets=4)
    meta = vectors.serving_metadata(again, docs.withColumn("kind", F.col("id") % 3), "id", ["kind"])
    assert meta.count() == 60 and meta.columns == ["chunk_id", "bucket", "kind"]


def test_registry_says_what_went_wrong(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d"), (5, "e")], "query_id int, asked string")
    some = agent.Tool("some", "asked string", "n int", lambda d: d.where("query_id <> 3").select("query_id", F.lit(1).alias("n"), F.when(F.col("query_id") == 4, F.lit("model_error")).when(F.col("query_id") == 5, F.lit("odd")).alias("error")))

    def fail(_):
        raise agent.ToolFailure("external_service_error")

    def crash(_):
        raise KeyError("x")

    tools = agent.Registry([
        some, agent.Tool("wrong", "", "n int", lambda d: d.select("query_id", F.lit("x").alias("n"))), agent.Tool("fail", "", "n int", fail), agent.Tool("crash", "", "n int", crash), agent.Tool("slow", "", "n int", lambda d: d.select("query_id", F.lit(1).alias("n")), timeout_seconds=0.0),
        agent.Tool("twice", "", "n int", lambda d: d.select("query_id", F.lit(1).alias("n")).union(d.where("query_id = 1").select("query_id", F.lit(2)))), agent.Tool("needs", "other string", "n int", crash),
    ])
    errors = lambda name: {r.query_id: r.error for r in tools.invoke(name, rows, "n int").collect()}
    assert errors("some") == {1: None, 2: "invalid_input", 3: "tool_contract_error", 4: "model_error", 5: "tool_contract_error"}
    assert errors("twice") == {1: "tool_contract_error", 2: None, 3: None, 4: None, 5: None}
    for name, kind in (("absent", "tool_not_registered"), ("wrong", "tool_contract_error"), ("fail", "external_service_error"), ("crash", "tool_contract_error"), ("slow", "timeout"), ("needs", "invalid_input")):
        assert set(errors(name).values()) == {kind} and len(errors(name)) == 5
    with pytest.raises(ValueError):
        agent.Registry([some, some])


def test_loop_with_real_tools(spark, corpus):
    limits = retrieval.Limits(top_k=2, candidate_k=3)
    q = spark.createDataFrame([(1, "thuê đất", ["hybrid", "bm25"]), (2, "không có gì", ["bm25"]), (3, "giao thông", ["telepathy", "bm25"])], "query_id int, question string, routes array<string>")
    tools = [*agent.search_tools(corpus, limits), agent.grading_tool(1, 0.9), agent.extraction_tool(1), agent.verification_tool()]
    got = {r.query_id: r for r in agent.run_agent(q, query.plan_variants(q, "query_id").select("query_id", "variant_id", "text"), agent.Registry(tools)).collect()}
    assert got[1].stop_reason == "answer_verified" and got[1].answer.endswith("[E1]") and "thuê" in got[1].answer and got[1].attempt == 1
    assert got[2].stop_reason == "no_new_strategy" and got[2].warnings == ["insufficient_context"] and got[2].outcome == "abstained"
    assert got[3].stop_reason == "non_retryable_tool_error" and got[3].warnings == ["retrieval:tool_not_registered"]


def test_header_identities():
    f = identity.header_identity
    assert f("CHÍNH PHỦ\n---\nSố: 15/2020/NĐ-CP.\nHà Nội\nNGHỊ\nĐỊNH\nQuy định xử phạt") == ("Nghị định", "15/2020/NĐ-CP")
    assert f("Thông\r\ntư\r\nliên tịch\r\nSố :\r\n12/2015/TTLT-BTC; x") == ("Thông tư liên tịch", "12/2015/TTLT-BTC")
    assert f("Căn cứ Luật số 5\nSố: 9/2020") == (None, None) and f("Luật: Đất đai\nĐiều 1. A\nSố: 3/2013") == ("Luật", None)
    assert f("Số: mười\nSố: 7/QĐ") == (None, "7/QĐ") and f("Số: TCVN:2015") == (None, "TCVN:2015") and f(None) == f("") == f("\n:-\n") == (None, None)
    assert f("\n".join([*["x"] * 60, "Luật"])) == (None, None) and f("Luật sư") == ("Luật", None) and f("luậtx") == (None, None)


def test_order_prefix_and_batch_problems(spark):
    asked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "k string, pos int")
    given = lambda rows: spark.createDataFrame(rows, "k string, pos int")
    assert gates.prefix_problems(asked, given([("a", 0), ("b", 1)]), "k", "pos").count() == 0 and gates.prefix_problems(asked, given([]), "k", "pos").count() == 0
    assert {r.k for r in gates.prefix_problems(asked, given([("a", 0), ("c", 1)]), "k", "pos").collect()} == {"b", "c"}
    assert {r.k for r in gates.order_problems(asked, given([("a", 0), ("b", 1), ("b", 2)]), "k", "pos").collect()} == {"b", "c"}
    lines = spark.createDataFrame([("a", "{}"), ("", "{}"), ("a", "{}"), (None, " ")], "k string, line string")
    assert {tuple(r) for r in gates.batch_problems(lines, "k", 5, "line").collect()} == {("blank_line", 1), ("blank_key", 1), ("repeated_key", 1), ("record_count", 2)}


def test_warmup_scores(spark):
    refs = spark.createDataFrame([("q1", "a b c", 0), ("q2", "x y", 1)], "question_id string, reference_answer string, pos int")
    good = spark.createDataFrame([("q1", "a c b", 0), ("q2", "x y", 1)], "question_id string, answer string, pos int")
    cases, total = gates.warmup_scores(refs, good)
    by = {r.question_id: r for r in cases.collect()}
    assert by["q1"].meteor == pytest.approx(0.5) and by["q1"].rouge_l == pytest.approx(2 / 3) and by["q1"].exact_match == 0 and by["q2"].exact_match == 1
    t = total.first()
    assert t.questions == 2 and t.rouge_l == pytest.approx((2 / 3 + 1) / 2) and t.exact_match == 0.5
    with pytest.raises(ValueError):
        gates.warmup_scores(refs, good.withColumn("pos", 1 - F.col("pos")))
    with pytest.raises(ValueError):
        gates.warmup_scores(refs.withColumn("reference_answer", F.lit(None).cast("string")), good)


def test_controls_are_refused_where_strata_lack(spark):
    schema = "question_id int, claims array<struct<has_negation:boolean,negation_match:boolean,has_number:boolean,numeric_match:boolean>>"
    rows = [(1, [(True, True, True, True)]), (2, [(False, None, True, True)]), (3, [(False, True, False, True)] * 2), (4, [(False, True, False, True)]), (5, [(True, False, True, False)])]
    df = spark.createDataFrame(rows, schema)
    assert {r.question_id: r.stratum for r in census.control_strata(df).collect()} == {1: "negation", 2: "numeric", 3: "multi_claim_clean", 4: "single_claim_clean", 5: None}
    with pytest.raises(ValueError, match="no stratum"):
        census.choose_controls(df, 1, 0, "s")
    assert census.choose_controls(df.where("question_id < 5"), 1, 0, "s").count() == 4
    with pytest.raises(ValueError, match="too few"):
        census.choose_controls(df.where("question_id < 5"), 1, 1, "s")


def test_queries_within_limits(spark):
    df = spark.createDataFrame([(1, "  a   b\n c ", None, None), (2, " ", None, None), (3, "x" * 30, None, None), (4, "é", 5, 3), (5, "é", 5, 9), (None, "q", None, None)], "query_id int, question string, top_k int, candidate_k int")
    made, refused = query.create_queries(df, max_chars=20)
    assert {(r.query_id, r.normalized_question, r.top_k, r.candidate_k) for r in made.collect()} == {(1, "a b c", 10, 20), (5, "é", 5, 9)}
    assert {tuple(r) for r in refused.collect()} == {(2, "blank_question"), (3, "question_too_long"), (4, "limits"), (None, "query_id")}


@pytest.mark.parametrize("goals", [{"a": "max", "b": "min"}, {"a": "max", "b": "min", "c": "max"}])
def test_pareto_as_brute_force(spark, goals):
    import random

    from textquarry.operators import analytics

    rng = random.Random(5)
    rows = [(i, rng.randrange(40), rng.randrange(40) / 4, rng.randrange(6)) for i in range(900)]
    sign = [1 if d == "max" else -1 for d in goals.values()]
    points = {r[0]: tuple(s * v for s, v in zip(sign, r[1:])) for r in rows}
    want = {i: any(q != p and all(x >= y for x, y in zip(q, p)) for q in points.values()) for i, p in points.items()}
    df = spark.createDataFrame(rows, "id int, a int, b double, c int")
    assert {r.id: r.dominated for r in analytics.pareto(df, "id", goals).collect()} == want and not all(want.values())
    assert analytics.pareto(df.limit(0), "id", goals).count() == 0


def test_warnings_ask_only_whether_a_search_has_hits(spark, corpus, monkeypatch):
    q = spark.createDataFrame([(1, "thuê đất xyz"), (2, "xyz abc"), (3, "?!"), (4, None), (5, "Luật")], "query_id int, question string").withColumn("rewritten", F.lit(None).cast("string"))
    variants = retrieval.active_variants(q)
    key = lambda df: {tuple(r) for r in df.select("query_id", "variant_id", "branch").collect()}
    want = key(retrieval.branches(variants, corpus, 1))
    monkeypatch.setattr(bm25, "HEAD_TERMS", 2)  # most terms are beyond the head
    assert key(retrieval.matched_branches(variants, corpus)) == want and len(want) == 5
    none = retrieval.Corpus(corpus.index, corpus.vectors.limit(0), corpus.texts, embed)
    assert {b for *_, b in key(retrieval.matched_branches(variants, none))} == {"bm25"}


def test_index_counts_terms_within_rows(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b a a"), (2, "A"), (3, ""), (4, None)], "id int, t string")
    index = bm25.build_index(docs, "id", "t")
    assert sorted(map(tuple, index.postings.select("chunk_id", "term", "tf", "doc_len").collect())) == [(1, "a", 4, 3), (1, "b", 2, 3), (2, "a", 1, 1)]
    assert {r.term: r.df for r in index.frequencies.collect()} == {"a": 2, "b": 1} and tuple(index.stats.first()) == (5, 7 / 5)
    plan = index.postings  # a text's counts need no shuffle of their own
    counted = docs.select("id", F.inline_outer(bm25._counted(F.split("t", " "))))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString() and plan.count() == 3


def test_references_out_of_force_dont_count(spark):
    from textquarry.plans import answers

    rows = [(1, 1, 1, "luật đất", "luật đất", "n1", "expired"), (2, 2, 1, "luật đất", "luật đất", "n1", "current")]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, text string, question string, document_number string, effect_status string")
    none = F.array().cast("array<string>")
    hits = hits.withColumns({"document_numbers": F.array(F.lit("n1")), "article_numbers": none, "article_number": F.lit(None).cast("string"), "document_id": F.col("document_number"), "token_count": F.lit(2)})
    q = hits.select("query_id", "question", F.lit(True).alias("wants_document"), F.lit(False).alias("wants_article"))
    got = lambda **k: {r.query_id: r.missing_aspects for r in answers.answer_questions(q, hits, **k).collect()}
    assert got() == {1: ["applicable_evidence"], 2: []}
    assert got(in_force=True) == {1: ["document_reference_match", "applicable_evidence"], 2: []}
