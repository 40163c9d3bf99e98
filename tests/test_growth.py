"""Steps whose shuffles, broadcasts or memory grew faster than their input, and whole results of cut queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry import catalog, catalog_cases, catalog_plans  # noqa: F401
from textquarry.operators import analytics, dataset, diagnostics, evidence, resampling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packets_show_missing_questions_and_chunks(spark):
    rows = catalog.queries()["control_packets"](spark, "/root/testdata/sf0.01").collect()
    assert {p for r in rows for p in r.problems.split(",")} >= {"missing_question", "missing_chunk"}
    assert all((r.question_id % 2 == 1) == ("missing_question" in r.problems) for r in rows)
    assert "missing_question" in catalog.oracle_sql()["control_packets"]


def test_containment_never_broadcasts_titles_or_links(spark):
    needles = spark.createDataFrame([(1, "ngan"), (2, "hanoi"), (3, "abc"), (4, None), (5, "ngan"), (6, "saigonx")], "needle_id int, slug string")
    titles = spark.createDataFrame([(1, "nganhang"), (2, "hanoinganhang"), (3, "saigon"), (4, None)], "title_id int, slug string")
    links = diagnostics.containment_links(needles, titles)
    assert sorted(map(tuple, links.collect())) == [(1, 1), (1, 2), (2, 2), (5, 1), (5, 2)]
    assert "title_id" not in "".join(x for x in plan(links).splitlines() if "BroadcastExchange" in x) and plan(links).count("SortMergeJoin") >= 2


def near_by_hand(docs, threshold=0.92, anchors=8, most=200):
    import hashlib
    import re

    texts = {}
    for i, t in docs:
        norm = re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
        if norm:
            low, n = texts.get(norm, (i, 0))
            texts[norm] = min(low, i), n + 1
    sets = {i: (n, {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {norm}) for norm, (i, n) in texts.items() for w in [norm.split(" ")]}
    f = {}
    for n, s in sets.values():
        for g in s:
            f[g] = f.get(g, 0) + n
    own = {i: sorted(s, key=lambda g: (f[g], hashlib.sha256(g.encode()).hexdigest()))[:anchors] for i, (n, s) in sets.items()}
    m = {}
    for i, gs in own.items():
        for g in gs:
            m[g] = m.get(g, 0) + sets[i][0]
    pairs = {(a, b) for a in own for b in own if a < b and any(1 < m[g] <= most for g in {*own[a]} & {*own[b]})}
    sim = lambda a, b: len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1])
    return sorted((a, b, sim(a, b)) for a, b in pairs if sim(a, b) >= threshold)


def test_near_pairs_are_those_of_the_definition_with_one_shuffle_of_shingles(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for i in range(60):
        base = [*rng.choice(words, 60)]
        docs += [(10 * i, " ".join(base)), (10 * i + 1, " ".join([*base, "one"])), (10 * i + 2, " ".join(["x", *base[1:]]))]
        docs += [(10 * i + 3, " ".join(base).upper())] * (i % 3 == 0) + [(10 * i + 4, " ".join(base[:30]))]
    docs += [(9000, "a b"), (9001, "A, b!"), (9002, None), (9003, ""), (9004, "a b c"), (9005, "a b c d")]
    df = spark.createDataFrame(docs, "id long, t string")
    for anchors, most in ((8, 200), (2, 3), (8, 2)):
        got = sorted(map(tuple, dataset.near_pairs(df, "id", "t", anchors=anchors, most=most).collect()))
        assert got == near_by_hand(docs, anchors=anchors, most=most) and (most != 200 or len(got) > 60)


def test_resamples_ship_a_groups_values_to_a_fixed_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 1 << 6)
    rows = [("a", k, float(k * k % 17)) for k in range(50)] + [("b", 1, 3.0)] + [(None, k, float(k)) for k in range(7)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    got = {r.g: r for r in analytics.bootstrap_interval(df, "g", "o", "v", 300, 5).collect()}
    for g in ("a", None):
        d = np.array([v for x, _, v in rows if x == g])
        means = d[np.random.default_rng(5).integers(0, len(d), (300, len(d)))].mean(1)
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    packed = spark.createDataFrame([("a", [1.0] * 50)], "g string, d array<double>")
    assert f"sequence(0, {resampling.DEALT - 1}" in resampling.resampled_means(packed, "g", "d", 10_000, 1)._jdf.queryExecution().analyzed().toString()


def test_gate_searches_no_ascii_and_knows_both_cases(spark):
    long = "x" * 50
    texts = ["short", long, long + "Ạ", long + "ỹ", long + "Đ", long + "é", long + "ơ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evidence.is_vietnamese(F.col("t")).alias("ok"))
    assert [r.ok for r in df.orderBy("i").collect()] == [True, False, True, True, True, False, True, None]
    assert "octet_length" in df._jdf.queryExecution().analyzed().toString()
