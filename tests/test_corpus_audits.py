"""Audits against plain computations, with blanks, ties and faults."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textquarry.operators import audits, diagnostics


def test_clusters_of_copies(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Tên  A", "tên a", "TÊN B", "x", " ", "", None, "é", "é"])) for i in range(80)] + [(100, "only")]
    df = spark.createDataFrame(rows, "id int, t string").withColumns({"kind": F.lit("clash"), "key": F.lit(1), "size": F.lit(2)})
    keys = {"exact": F.col("t"), "folded": audits.folded(F.col("t")), "none": F.lit(None).cast("string")}
    plain = {"exact": lambda t: t, "folded": lambda t: " ".join(t.split()).lower()}
    got = {r.kind: r for r in audits.duplicate_clusters(df, "id", keys).collect()}
    big = {r.kind: [] for r in got.values()}
    for r in audits.largest_clusters(df, "id", keys, most=3, sample=4).orderBy("place").collect():
        big[r.kind].append((r["size"], r.ids))
    for kind, f in plain.items():
        found = defaultdict(list)
        for i, t in rows:
            if t and t.strip():
                found[f(t)].append(i)
        some = [v for v in found.values() if len(v) > 1]
        assert (got[kind].clusters, got[kind].records) == (len(some), sum(map(len, some))) and got[kind].share == pytest.approx(100 * sum(map(len, some)) / len(rows))
        assert big[kind] == [(len(v), v[:4]) for v in sorted(some, key=lambda v: (-len(v), v[0]))[:3]]
    assert "none" not in got and audits.duplicate_clusters(df.limit(0), "id", keys).count() == 0


def test_line_ends_and_composition(spark):
    texts = ["a\r\nb", "a\nb", "a\rb", "a\r\nb\n", "a\r\n\rb", "ab", "", None, "é", "é\r\n"]
    (r,) = audits.style_profile(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert r.asDict() == {"texts": 10, "crlf": 2, "lf": 1, "cr": 1, "mixed": 2, "none": 4, "not_composed": 1}
    top = audits.largest_documents(spark.createDataFrame([(3, "aa bb"), (1, "cc dd"), (2, " "), (4, None), (5, "x" * 9)], "id int, t string"), "id", "t", 2).collect()
    assert [(r.id, r.chars, r.words) for r in top] == [(5, 9, 1), (1, 5, 2)]


def test_pools_that_grow(spark):
    rng = random.Random(2)
    rows = [(q, rng.randint(0, 10**6), f"d{rng.randint(0, 6)}", r, rng.choice([0.1, 0.2, 0.3, rng.random()])) for q in range(30) for r in range(1, rng.choice([3, 12, 20, 41, 50]))]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, document_id string, fused_rank int, score double")
    got = {r.query_id: r for r in audits.pool_audit(df).collect()}
    for q in range(30):
        pool = [(-round(s, 8), r, c, d) for i, c, d, r, s in rows if i == q]
        a, b = sorted(x for x in pool if x[1] <= 20)[:8], sorted(x for x in pool if x[1] <= 40)[:8]
        new, gone = [x for x in b if x not in a], [x for x in a if x not in b]
        margin = round(min(-x[0] for x in new) - max(-x[0] for x in gone), 8) if new and gone else None
        buckets = {f"{k}-{k + 4}": sum(k <= x[1] <= k + 4 for x in new) for k in (21, 26, 31, 36)}
        r = got[q]
        assert (r.identical, r.overlap, r.entrants, r.displaced, r.buckets, r.margin) == (a == b, len({*a} & {*b}), len(new), len(gone), buckets, margin)
        assert r.jaccard == len({*a} & {*b}) / len({*a} | {*b}) and r.new_documents == len({x[3] for x in b} - {x[3] for x in a}) and (r.shallow_cutoff, r.deep_cutoff) == (-a[-1][0], -b[-1][0])
    one = audits.pool_summary(audits.pool_audit(df)).first()
    assert one.cases == 30 and one.identical_cases + one.changed_cases == 30 and one.entrants == sum(r.entrants for r in got.values())
    assert {r.bucket: r.entrants for r in audits.entrant_buckets(audits.pool_audit(df)).collect()} == {k: sum(r.buckets[k] for r in got.values()) for k in ("21-25", "26-30", "31-35", "36-40")}


def test_paired_runs(spark):
    run = lambda rows: spark.createDataFrame(rows, "question_id int, answer string, status string, hit_max boolean")
    refs = spark.createDataFrame([(1, "abc"), (2, "defg"), (3, None)], "question_id int, reference string")
    a, b = run([(1, "ab", "success", True), (2, "de", "success", None)]), run([(1, "abc", "success", False), (2, "de", "success", False), (9, "x", "failed", True)])
    runs = audits.paired_runs(a, b, refs)
    r = audits.length_report(runs).first()
    assert (r.cases, r.base_chars, r.treatment_chars, r.reference_chars, r.chars_delta) == (2, 2.0, 2.5, 3.5, 0.5)
    assert r.warnings == ["base_generations_hit_max_tokens_count_1", "screening_potentially_censored"]
    s = runs.withColumns({"base_m": F.length("base_answer"), "treatment_m": F.length("treatment_answer")})
    (m,) = audits.paired_report(s, ["m"]).collect()
    assert (m.cases, m.win, m.tie, m.loss, m.mean_delta, m.median_delta) == (2, 1, 1, 0, 0.5, 0.5)
    for bad, message in ((run([(1, "ab", "success", True)]), "no answer to 2"), (run([(1, "ab", "error", True), (2, "x", "success", None)]), "failed generation for 1"), (run([(1, "GENERATION_ERROR: x", "success", True), (2, "x", "success", None)]), "failed generation for 1")):
        with pytest.raises(Exception, match=message):
            audits.length_report(audits.paired_runs(bad, b, refs)).collect()


def test_every_signal_of_a_search(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, document_id string, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id int")
    a = hits([(q, 1, 1, "d", "alpha beta") for q in (1, 2, 3, 4)] + [(1, 2, 2, "e", "gamma")])
    b = hits([(1, 1, 1, "d", "alpha beta"), (2, 9, 1, "d", "x"), (3, 1, 1, "d", "alpha beta"), (4, 1, 1, "d", "alpha beta")])
    hybrid = hits([(1, 1, 1, "d", "alpha beta"), (1, 2, 2, "e", "gamma")] + [(2, k, k, "d", "zeta") for k in range(1, 6)] + [(3, 1, 1, "d", "alpha beta"), (4, 1, 1, "d", "alpha beta")])
    answers = spark.createDataFrame([(1, "alpha gamma"), (2, "alpha beta gamma"), (3, "alpha"), (4, "alpha"), (5, None)], "query_id int, answer string")
    refs = spark.createDataFrame([(1, True), (3, False), (5, None)], "query_id int, matched boolean")
    reranked = hits([(1, 2, 1, "e", "gamma"), (3, 1, 1, "d", "alpha beta")])
    got = {r.query_id: r for r in diagnostics.diagnose(ids(1, 2, 3, 4, 5), a, b, hybrid, answers, references=refs, warned=ids(3, 3), failed=ids(4), reranked=reranked).collect()}
    assert {q: r.signals for q, r in got.items()} == {
        1: [], 2: ["zero_branch_overlap", "low_document_diversity", "low_answer_term_coverage"], 3: ["explicit_reference_not_retrieved", "retrieval_warning"], 4: ["retrieval_error"],
        5: ["no_bm25_hits", "no_dense_hits", "no_hybrid_hits"],
    }
    assert (got[1].reranked_overlap, got[1].reranked_jaccard, got[1].reranked_diversity, got[1].coverage_gain) == (1, 0.5, 1.0, -0.5) and got[2].reranked_overlap == 0 and got[3].coverage_gain == 0.0 and got[5].coverage is None
    plain = diagnostics.diagnose(ids(1), a, b, hybrid, answers).first()
    assert plain.signals == [] and plain.explicit_match is None


def test_labels_are_bound_to_their_texts(spark):
    packets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e"), (5, "e")], "id int, t string")
    good = packets.where("id < 5").select("id", F.lit("yes").alias("label"), F.sha2(F.coalesce("t", F.lit("")), 256).alias("text_sha256"))
    assert audits.freeze_problems(packets.where("id < 5"), good, ["id"], "t", ["yes", "no"]).count() == 0
    bad = good.where("id <> 3").withColumn("text_sha256", F.when(F.col("id") != 2, F.col("text_sha256"))).withColumn("label", F.when(F.col("id") == 1, F.lit("maybe")).otherwise(F.col("label")))
    bad = bad.union(spark.createDataFrame([(9, None, "x"), (9, "no", "x")], "id int, label string, text_sha256 string"))
    got = sorted((r.id, r.problem) for r in audits.freeze_problems(packets, bad, ["id"], "t", ["yes", "no"]).collect())
    assert got == sorted([(3, "unreviewed_packet"), (5, "unreviewed_packet"), (5, "unreviewed_packet"), (9, "review_without_packet"), (9, "review_without_packet"), (5, "repeated_packet"), (9, "repeated_review"), (2, "text_changed"), (1, "unknown_label"), (9, "unknown_label")])
    assert {r.label: r.n for r in audits.frozen_classes(bad, ["yes", "no", "other"]).collect()} == {"yes": 2, "no": 1, "other": 0}
