"""Artifacts, streams, groups and answers that stopped writers, repeats and bad generators can't spoil."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from textquarry.operators import dataset
from textquarry.plans import answers
from textquarry.sources import json_sources as js
from textquarry.streaming import ingest


def test_a_stopped_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    df, path = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string"), str(tmp_path / "art")
    whole = js.artifact_manifest
    monkeypatch.setattr(js, "artifact_manifest", lambda d: (_ for _ in ()).throw(KeyboardInterrupt("stopped after the data")))
    with pytest.raises(KeyboardInterrupt):
        js.write_artifact(df, path)
    assert not os.path.exists(path) and len(os.listdir(tmp_path)) == 1
    monkeypatch.setattr(js, "artifact_manifest", whole)
    assert js.write_artifact(df, path).first().records == 2 and js.read_artifact(spark, path, df.schema).count() == 2
    assert spark.read.schema(df.schema).json(path).count() == 2  # the manifest isn't among the rows
    assert js.discard_staging(spark, path) == 1 and sorted(os.listdir(tmp_path)) == ["art"]
    with pytest.raises(js.InvalidSource, match="exists already"):
        js.write_artifact(df.limit(1), path)
    assert js.read_artifact(spark, path, df.schema).count() == 2 and sorted(os.listdir(tmp_path)) == ["art"]


def test_ingestion_takes_a_document_once_and_repeats_a_stopped_batch(spark, tmp_path, monkeypatch):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "id string, t string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest.ingest_chunks(spark, src, schema, out, cp, "id", "t").awaitTermination(120)
    ids = lambda: sorted(r.document_id for r in ingest.ingested(spark, out).select("document_id").distinct().collect())
    assert ingest.ingested(spark, out) is None
    put([("a", "Điều 1. Một\nNội dung."), ("a", "Điều 1. Một\nNội dung."), ("b", "Chữ."), (None, "x"), ("e", None)])
    run()
    n = ingest.ingested(spark, out).count()
    assert ids() == ["a", "b"] and n == ingest.ingested(spark, out).select("chunk_id").distinct().count()
    real = ingest.chunk_documents
    put([("b", "Khác."), ("c", "Mới.")])

    def stops(*args):
        spark.createDataFrame([("half",)], "document_id string").write.mode("overwrite").parquet(f"{out}/batch=1")
        raise RuntimeError("stopped within the batch")

    monkeypatch.setattr(ingest, "chunk_documents", stops)
    with pytest.raises(Exception, match="stopped within the batch"):
        run()
    monkeypatch.setattr(ingest, "chunk_documents", real)
    run()
    run()
    assert ids() == ["a", "b", "c"] and ingest.ingested(spark, out).where("batch = 0").count() == n
    assert not [x for x in os.listdir(f"{cp}") if x == "state"]  # the stream holds none


def test_group_digests_are_carried_over_batches(spark):
    rows = [(i, f"g{i % 3}") for i in range(200)] + [(None, "g0"), (7, None)]
    df = spark.createDataFrame(rows, "id int, group_id string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.group_id: (r.n, r.h) for r in dataset._group_order(df, 9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("g0", "g1", "g2", None):
        ids = [i for i, x in rows if x == g]
        assert got[g] == (len(ids), hashlib.sha256(("9:" + "|".join(sorted(str(i) for i in ids if i is not None))).encode()).hexdigest())
    assert dataset._group_order(df.limit(0), 9).count() == 0


def test_a_group_of_millions_of_ids(spark):
    n = 2_000_000
    df = spark.range(n, numPartitions=8).select("id", F.lit("hot").alias("group_id"))
    (r,) = dataset._group_order(df, 1).collect()
    h = hashlib.sha256(b"1:" + "|".join(sorted(map(str, range(n)))).encode()).hexdigest()
    assert (r.n, r.h) == (n, h)


def test_documents_without_candidates_are_unresolved(spark):
    c = spark.createDataFrame([(1, "header", "A"), (1, "title", "A"), (2, "url", None)], "document_id int, source string, value string")
    docs = spark.createDataFrame([(1,), (2,), (3,), (3,)], "document_id int")
    assert sorted((r.document_id, r.status, r.value) for r in dataset.resolve_identity(c, docs).collect()) == [(1, "strict", "A"), (2, "unresolved", None), (3, "unresolved", None)]


HITS = "query_id int, chunk_id int, rank int, text string, question string, document_numbers array<string>, article_numbers array<string>, document_number string, article_number string, effect_status string, document_id string, token_count int"


def _case(spark, n=4):
    q = spark.createDataFrame([(i, "Mức phạt vượt đèn đỏ", i == 2, False) for i in range(n)], "query_id int, question string, wants_document boolean, wants_article boolean")
    text = "Mức phạt vượt đèn đỏ là 800 nghìn đồng."
    rows = [(i, 10 * i + k, k + 1, text, "Mức phạt vượt đèn đỏ", None, None, None, None, None, f"d{k}", 10) for i in range(n) if i != 1 for k in range(2)]
    return q, spark.createDataFrame(rows, HITS)


def test_answers_stand_only_if_graded_and_verified(spark):
    q, hits = _case(spark)
    got = {r.query_id: r for r in answers.answer_questions(q, hits).collect()}
    assert {*got} == {0, 1, 2, 3} and [got[i].insufficient_evidence for i in range(4)] == [False, True, True, False]
    assert got[0].answer.startswith("[E1] Mức phạt") and got[0].citation_ids == ["E1", "E2"] and got[0].warnings == [] and got[0].supported_claims == got[0].claims == 2
    assert got[1].warnings == got[2].warnings == ["insufficient_context"] and got[1].answer == answers.ABSTENTION and got[1].hit_count == 0 and got[2].missing_aspects == ["document_reference_match"]


@pytest.mark.parametrize("answer, cites, fault", [
    ("Mức phạt vượt đèn đỏ là 900 nghìn đồng. [E1]", ["E1"], "numeric_mismatch"), ("Mức phạt vượt đèn đỏ. [E7]", ["E7"], "unknown_evidence_marker"), ("Mức phạt vượt đèn đỏ.", ["E1"], "missing_inline_evidence"),
    ("Mức phạt vượt đèn đỏ. [E1]", ["E1", "E2"], "unused_citation"), ("Mức phạt vượt đèn đỏ. [E1]", ["E1", "E9"], "unknown_citation"), ("Mức phạt vượt đèn đỏ. [E1]", None, "answer_marker_missing_citation"), ("  ", ["E1"], "missing_answer"), (None, None, "missing_answer"),
])
def test_bad_answers_become_abstentions(spark, answer, cites, fault):
    q, hits = _case(spark)
    bad = lambda asked, given: asked.select("question_id", F.lit(answer).cast("string").alias("answer"), (F.array(*map(F.lit, cites)) if cites else F.lit(None)).cast("array<string>").alias("citation_ids"))
    (r,) = answers.answer_questions(q, hits, bad).where("query_id = 0").collect()
    assert r.insufficient_evidence and r.answer == answers.ABSTENTION and r.citation_ids == [] and r.warnings[0] == "citation_verification_failed" and fault in r.warnings


def test_missing_repeated_and_foreign_answers(spark):
    q, hits = _case(spark)
    good = lambda a, g: answers.extract(a, g)
    twice = lambda a, g: good(a, g).union(good(a, g)).union(good(a, g).withColumn("question_id", F.lit(99)))
    got = {r.query_id: r for r in answers.answer_questions(q, hits, twice).collect()}
    assert {*got} == {0, 1, 2, 3} and got[0].warnings == ["citation_verification_failed", "several_answers"]
    none = {r.query_id: r for r in answers.answer_questions(q, hits, lambda a, g: good(a, g).limit(0)).collect()}
    assert none[3].warnings == ["citation_verification_failed", "missing_answer"] and none[1].warnings == ["insufficient_context"]
    assert answers.answer_questions(q.limit(0), hits).count() == 0
    (ok,) = answers.answer_questions(q.where("query_id = 0"), hits, lambda a, g: a.select("question_id", F.lit("Mức phạt vượt đèn đỏ là 800 nghìn đồng. [E1]").alias("answer"), F.array(F.lit("E1")).alias("citation_ids"))).collect()
    assert not ok.insufficient_evidence and ok.citation_ids == ["E1"]
