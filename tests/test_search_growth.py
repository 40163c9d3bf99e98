"""Searches that don't shuffle what their queries don't ask for, and vectors worked out a batch at a time."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from textquarry.operators import bm25, vectors
from textquarry.plans import retrieval

DOCS = [(1, "một hai ba hai"), (2, "Hai bốn"), (3, None), (4, " .. "), (5, "năm 2024 không"), (5, "năm 2024 không"), (5, "sáu"), (6, "một " * 9)]
ASKS = [("a", "hai một"), ("b", "không 2024 chín"), ("c", "xyz"), ("d", None)]


def test_searches_of_asked_terms_equal_those_of_the_whole_index(spark):
    docs = spark.createDataFrame(DOCS, "id long, t string")
    asks = spark.createDataFrame(ASKS, "q string, t string")
    whole = bm25.build_index(docs, "id", "t")
    hits = lambda index: sorted(map(tuple, bm25.search(bm25.plan_queries(asks, index, "q", "t"), index).collect()))
    asked = {w for _, t in ASKS for w in (t or "").split()}
    for most in (100, 0):
        index = bm25.index_for(asks, "t", docs, "id", "t", most)
        assert hits(index) == hits(whole) != []
        assert index.stats.collect() == whole.stats.collect()
        own = {tuple(r) for r in index.postings.collect() if r.term in asked}
        assert own == {tuple(r) for r in whole.postings.collect() if r.term in asked} and (most == 0 or index.postings.count() == len(own))
    none = bm25.index_for(asks.limit(0), "t", docs, "id", "t")
    assert none.stats.collect() == whole.stats.collect() and none.postings.count() == 0


def test_a_corpus_without_a_stored_index_reads_the_asked_terms_alone(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS[:4], "chunk_id long, text string")
    embed = lambda d, c: vectors.hashing_embedder(d, c, 8)
    given = embed(docs, "text").select("chunk_id", "embedding")
    asks = spark.createDataFrame([("a", "hai một"), ("b", "bốn")], "query_id string, question string").withColumn("rewritten", F.lit(None).cast("string"))
    found = lambda index: sorted(map(tuple, retrieval.search(asks, retrieval.Corpus(index, given, docs, embed), ("bm25", "hybrid", "hybrid_rerank")).collect()))
    expected = found(bm25.build_index(docs, "chunk_id", "text"))
    monkeypatch.setattr(bm25, "build_index", None)
    assert found(None) == expected != []


def test_hits_leave_the_payload_where_it_is(spark, tmp_path):
    spark.range(1000).select("id", F.lit("x").alias("text")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    hits = docs.select(F.col("id").alias("chunk_id")).crossJoin(docs.select(F.col("id").alias("b"))).where("b = 1 and chunk_id < 5").select("chunk_id")
    found = vectors.late_materialise(hits, docs, "id")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5


def test_embeddings_and_blocks_equal_those_by_hand(spark):
    texts = [(i, t) for i, (_, t) in enumerate(DOCS)] + [(100, "a b a c " * 700)]

    def by_hand(t):
        v = np.zeros(16)
        for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split():
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += -1 if int(h[8], 16) % 2 else 1
        return v if (t or "").strip(" .") else None

    got = {r.i: r.embedding for r in vectors.hashing_embedder(spark.createDataFrame(texts, "i long, t string"), "t", 16).collect()}
    for i, t in texts:
        assert (got[i] is None and by_hand(t) is None) or list(by_hand(t)) == got[i]

    nan, inf = float("nan"), float("inf")
    rows = [(1, [3.0, 4.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [0.1, -0.7]), (8, [inf, 1.0]), (9, [1e30, 1e30]), (10, [1.0] * 3 + [nan])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    held = {}
    for r in vectors.blocks(df, "i", "v", 2).collect():
        m = np.frombuffer(bytes(r["matrix"])).reshape(len(r.ids), -1)
        held |= {i: list(x) for i, x in zip(r.ids, m)}
    assert held == {r.i: r.v for r in vectors.normalise(df, "v").collect()} and set(held) == {1, 7, 9}
    assert "aggregate" not in vectors.blocks(df, "i", "v")._jdf.queryExecution().analyzed().toString().lower()
