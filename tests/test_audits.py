"""Audits of chunks, contexts, benchmarks and resumed batches."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.operators import chunking, cleaning, parsing
from textquarry.sources import json_sources as js
from textquarry.streaming import ingest

LAW = "Điều 1. Phạm vi\n1. Một hai ba.\n2. Bốn.\nĐiều 2. Đối tượng\n" + "từ " * 700


def test_every_chunk_problem_is_found(spark):
    docs = spark.createDataFrame([("d", LAW), ("e", "Điều 9. Khác\nNội dung.")], "document_id string, t string")
    blocks, chunks = parsing.parse_documents(docs, "document_id", "t").cache(), chunking.chunk_documents(docs, "document_id", "t").cache()
    ids = docs.select("document_id")
    assert chunking.chunk_problems(ids, blocks, chunks).count() == 0
    first = chunks.where("chunk_index = 0 and document_id = 'e'").first().chunk_id
    split = chunks.where("strategy = 'token_fallback' and split_index = 1").first().chunk_id
    at = lambda c, value: chunks.withColumn(c, F.when(F.col("chunk_id") == first, value).otherwise(F.col(c)))
    seen = lambda ch, bl=blocks, d=ids, **k: {r.problem for r in chunking.chunk_problems(d, bl, ch, **k).collect()}
    assert seen(chunks.union(chunks.where(F.col("chunk_id") == first))) >= {"duplicate_chunk_id", "index_gap"}
    assert seen(chunks, d=ids.where("document_id = 'd'")) == {"unknown_document"}
    assert seen(at("text", F.lit(" "))) >= {"empty_text", "token_count_mismatch", "text_differs_from_blocks"}
    assert seen(at("token_count", F.lit(999))) == {"token_count_mismatch", "over_budget"}
    assert seen(chunks, min_tokens=10) == {"below_minimum"}
    assert seen(at("search_text", F.concat(F.repeat(F.lit("x "), F.lit(500)), F.col("text")))) == {"search_text_over_budget"}
    assert seen(at("search_text", F.lit("other"))) == {"text_not_in_search_text"}
    assert seen(at("source_block_ids", F.array().cast("array<string>"))) == {"missing_source_blocks", "uncovered_block"}
    assert seen(at("source_block_ids", F.concat("source_block_ids", F.array(F.lit("nope"))))) == {"unknown_block"}
    foreign = blocks.withColumn("document_id", F.when(F.col("document_id") == "e", F.lit("d")).otherwise(F.col("document_id")))
    assert seen(chunks, foreign) == {"foreign_block"}
    assert seen(chunks.withColumn("text", F.when(F.col("chunk_id") == split, F.lit("từ")).otherwise(F.col("text")))) >= {"windows_differ_from_blocks"}
    assert seen(chunks.where(F.col("chunk_id") != split)) == {"windows_differ_from_blocks"}  # the last chunk: the order has no gap
    assert seen(chunks.where(F.col("chunk_id") != first)) == {"uncovered_block", "no_chunks"}
    assert seen(chunks.withColumn("lang", F.lit("vi")), d=ids.withColumn("lang", F.when(F.col("document_id") == "d", F.lit("vi"))), inherited=("lang",)) == {"metadata_differs"}


def test_windows_by_a_model_count():
    count = lambda t: len(t.replace(" ", ""))  # noqa: E731 - characters
    t = "aaa bb c dddd ee f"
    assert chunking.split_exact(t, 6, 0, count) == ["aaa bb c", "dddd ee"[:7], "f"] and chunking.split_exact(t, 6, 1, count) == ["aaa bb c", "c dddd", "dddd ee", "ee f"]
    assert chunking.split_exact(" x ", 5, 1, count) == ["x"] and chunking.split_exact("", 5, 1, count) == []
    with pytest.raises(ValueError):
        chunking.split_exact("aaaaaaa b", 3, 0, count)
    words = " ".join(f"w{i}" for i in range(50))
    assert chunking.split_exact(words, 10, 3, chunking.count_tokens) == chunking.split_tokens(words, 10, 3)


def test_marker_like_lines_are_reported(spark):
    df = spark.createDataFrame([("a", "Điều 1. A\nĐiều này quy định"), ("b", "Điều 1. A")], "id string, t string")
    rows = {r.document_id: r for r in parsing.parse_diagnostics(df, parsing.parse_documents(df, "id", "t"), "id", "t").collect()}
    assert rows["b"].issue is None and rows["b"].unrecognised == 0
    assert rows["a"].unrecognised in (0, 1) and rows["a"].issue == ("unrecognized_structure_marker" if rows["a"].unrecognised else None)


def test_corpus_audit_counts(spark):
    rows = [("1", "A", "u", "x<br>y"), ("2", "A", "u", "x<br>y"), ("3", None, None, "e\u0301\r\nz"), ("4", "B", "v", "  "), ("5", "C", "w", None), ("5", "D", "x", "p Thông báo")]
    df = spark.createDataFrame(rows, "context_id string, title string, source_url string, passage string")
    r = cleaning.corpus_audit(df, ("Thông báo",), 6).first()
    assert (r.members, r.unique_ids, r.with_content, r.blank, r.missing_title, r.duplicate_titles, r.duplicate_urls, r.duplicate_passages) == (6, 5, 4, 2, 1, 1, 1, 1)
    assert (r.with_markup, r.with_boilerplate, r.boilerplate_occurrences, r.with_script, r.modified, r.not_composed, r.newlines_changed) == (2, 1, 1, 0, 5, 1, 1)
    with pytest.raises(Exception, match="members expected"):
        cleaning.corpus_audit(df, (), 7).collect()


def test_benchmarks_match_their_manifest(spark, tmp_path):
    import hashlib

    data = "\n".join(json.dumps({"case_id": i, "question": "q", "target_granularity": k}) for i, k in (("a", "chunk"), ("b", "document"))) + "\n\n"
    (tmp_path / "b.jsonl").write_text(data)
    good = {"benchmark_sha256": hashlib.sha256(data.encode()).hexdigest(), "case_count": 2, "target_granularities": ["document", "chunk"]}
    schema, path = "case_id string, question string, target_granularity string", str(tmp_path / "b.jsonl")

    def load(manifest):
        (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
        return js.read_benchmark(spark, path, schema, str(tmp_path / "m.json"))

    assert {r.case_id for r in load(good).collect()} == {"a", "b"} and load(good).first().file_sha256 == good["benchmark_sha256"]
    for bad in ({"benchmark_sha256": "0"}, {"case_count": 3}, {"target_granularities": ["chunk"]}):
        with pytest.raises(js.InvalidSource):
            load(good | bad)
    for text in ("", data + data, data + "{not json}\n"):
        (tmp_path / "b.jsonl").write_text(text)
        with pytest.raises(js.InvalidSource):
            js.read_benchmark(spark, path, schema)


def test_resumed_batches_are_ordered_beginnings(spark, tmp_path):
    q = spark.createDataFrame([(f"q{i}", i) for i in range(5)], "question_id string, pos int")
    path = str(tmp_path / "answers")
    first = lambda n: lambda left: left.orderBy("pos").limit(n)
    assert ingest.resume_answers(q, path, first(2), pos_col="pos") == 5
    assert ingest.resume_answers(q, path, first(9), pos_col="pos") == 3
    assert ingest.resume_answers(q, path, first(9), pos_col="pos") == 0
    with pytest.raises(ValueError):
        ingest.resume_answers(q.withColumn("pos", 4 - F.col("pos")), path, first(9), pos_col="pos")
