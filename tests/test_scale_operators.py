"""Operators for groups, fronts, needles and query sets of any size, against plain computations."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import analytics, batches, diagnostics, ranks, resampling, vectors


def test_exact_ranks_as_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random(), float(rng.randint(0, 5))])) for _ in range(3000)] + [("one", 3.0), ("none", None)] + [("same", 7.0)] * 500
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.exact_ranks(df, ["k"], "v", {"p50": ranks.nearest(0.5), "p95": ranks.nearest(0.95), "f90": ranks.floored(0.9), "top": lambda n: n - 1}).collect()}
    assert {*got} == {"a", "b", None, "one", "same"}
    for k, r in got.items():
        s = sorted(v for g, v in rows if g == k and v is not None)
        assert (r.n, r.p50, r.p95, r.f90, r.top) == (len(s), s[round((len(s) - 1) * 0.5)], s[round((len(s) - 1) * 0.95)], s[min(int(len(s) * 0.9), len(s) - 1)], s[-1])
    assert ranks.exact_ranks(df.limit(0), ["k"], "v", {"p50": ranks.nearest(0.5)}).count() == 0
    (whole,) = ranks.exact_ranks(df, [], "v", {"p50": ranks.nearest(0.5)}).collect()
    assert whole.p50 == sorted(v for _, v in rows if v is not None)[round((whole.n - 1) * 0.5)]


def test_exact_ranks_of_a_group_of_ten_million_values(spark):
    n = 10_000_000
    df = spark.range(n, numPartitions=16).select(F.when(F.col("id") % 1000 == 0, F.lit("few")).otherwise(F.lit("hot")).alias("k"), ((F.col("id") * 7919) % 4_000_037).alias("v"))
    got = {r.k: r for r in ranks.exact_ranks(df, ["k"], "v", {"p50": ranks.nearest(0.5), "p95": ranks.nearest(0.95)}).collect()}
    ids = np.arange(n, dtype=np.int64)
    for k, some in (("few", ids[ids % 1000 == 0]), ("hot", ids[ids % 1000 != 0])):
        v = np.sort(some * 7919 % 4_000_037)
        assert (got[k].n, got[k].p50, got[k].p95) == (len(v), v[round((len(v) - 1) * 0.5)], v[round((len(v) - 1) * 0.95)])


def test_places_in_a_whole_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 20)) for i in range(2000)]
    got = ranks.ranked(spark.createDataFrame(rows, "id int, v int").repartition(7), [F.desc("v"), F.asc("id")]).collect()
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[1], r[0])) and sorted(r["rank"] for r in got) == [*range(1, 2001)]


@pytest.mark.parametrize("n, resamples, stretch", [(1, 5, 64), (2, 40, 64), (100, 300, 4096), (1000, 50, 1 << 21), (3_000_000, 2, 1 << 20)])
def test_resamples_are_those_of_one_generator(spark, monkeypatch, n, resamples, stretch):
    d = np.random.default_rng(5).normal(size=n)
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    words = resampling.accepted(2026, 0, 4 * n + 64, n) if n > 1 else np.zeros(64, np.int64)
    assert (words[: 2 * n] == np.random.default_rng(2026).integers(0, n, size=(2, n)).ravel()).all()
    if n <= 1000:
        packed = spark.createDataFrame([("g", d.tolist()), (None, d[:1].tolist())], "g string, d array<double>")
        want = d[np.random.default_rng(2026).integers(0, n, size=(resamples, n))].mean(1)
        got = [r["mean"] for r in sorted(resampling.resampled_means(packed, "g", "d", resamples, 2026).where("g = 'g'").collect(), key=lambda r: r.r)]
        assert got == want.tolist()
        df = spark.createDataFrame([("g", i, x) for i, x in enumerate(d.tolist())], "g string, i int, d double").repartition(3)
        (r,) = analytics.bootstrap_interval(df, "g", "i", "d", resamples).collect()
        assert (r.n, r.mean, r.median, r.low, r.high) == (n, d.mean(), np.median(d), *np.percentile(want, [2.5, 97.5]))


def test_rejected_words_shift_later_resamples():
    n = (1 << 31) + 12345  # about half of all words are rejected
    one = resampling.accepted(7, 0, 4000, n)
    assert 1000 < len(one) < 3000 and (one == np.random.default_rng(7).integers(0, n, size=len(one))).all()
    assert (np.concatenate([resampling.accepted(7, at, 100, n) for at in range(0, 4000, 100)]) == one).all()


@pytest.mark.parametrize("shape", ["ball", "line", "few", "nulls"])
def test_fronts_of_three_objectives(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    if shape == "ball":
        x = np.abs(x) / np.linalg.norm(x, axis=1)[:, None]  # all of them are the front
        x[::3] *= 0.99
    if shape == "line":
        x[:, 2] = -x[:, 0]
    if shape == "few":
        x = np.round(x)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    if shape == "nulls":
        rows = [(i, None if i % 50 == 0 else a, b, float("nan") if i % 70 == 0 else c) for i, a, b, c in rows]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r.id: r.dominated for r in analytics.pareto(df, "id", {"a": "max", "b": "max", "c": "min"}).collect()} if shape != "nulls" else None
    y = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows]) * [1, 1, -1]
    want = {i: bool(((y >= y[i]).all(1) & (y > y[i]).any(1)).any()) for i in range(len(y))}
    if shape == "nulls":
        vec = df.select(F.col("a").alias("p"), F.col("b").alias("q"), (-F.col("c")).alias("r")).distinct()
        front = analytics._dominated(vec, ["p", "q", "r"], strong=20, cells=64, block=50).where("not dominated").count()
        assert front == sum(not v for v in want.values())
    else:
        assert got == want and (shape == "few" or any(not v for v in want.values()))
        vec = df.select(F.col("a").alias("p"), F.col("b").alias("q"), (-F.col("c")).alias("r")).distinct()
        small = analytics._dominated(vec, ["p", "q", "r"], strong=5, cells=27, block=40)
        assert small.where("not dominated").count() == len({tuple(y[i]) for i, v in want.items() if not v})
        plan = small._jdf.queryExecution().toString()
        assert plan.count("NestedLoop") == 0 or shape


def test_containment_of_needles_of_a_thousand_lengths(spark):
    rng = random.Random(4)
    titles = [(i, "".join(rng.choices("abcd", k=rng.randint(0, 60)))) for i in range(200)] + [(200, "x" * 3000 + "abcdabcd"), (201, None), (202, "aaaa" * 300)]
    needles = [(i, "x" * (i + 4)) for i in range(1000)] + [(1000 + i, t[1][a : a + k]) for i, t in enumerate(titles[:150]) for a, k in [(rng.randint(0, 20), rng.randint(2, 9))]]
    needles += [(2000, None), (2001, ""), (2002, "abc"), (2003, "zzzz"), (2004, needles[1001][1]), (2004, needles[1001][1])]
    got = {(r.needle_id, r.title_id) for r in diagnostics.containment_links(spark.createDataFrame(needles, "needle_id int, slug string"), spark.createDataFrame(titles, "title_id int, slug string")).collect()}
    assert got == {(a, b) for a, n in needles if n and len(n) >= 4 for b, t in titles if t and n in t} and len(got) > 1000


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[40:60] = x[40]  # ties
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "id int, v array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -np.inf)
    for k, block in ((5, 32), (400, 64), (3, 2048)):
        got = {}
        for r in vectors.cosine_top_k(df, df, k, "id", "id", "v", exclude_same=True, block=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
        want = {i: [int(j) for j in np.lexsort((np.arange(300), -s[i]))[: min(k, 299)]] for i in range(300)}
        assert {i: [g[r] for r in sorted(g)] for i, g in got.items()} == want
    assert vectors.cosine_top_k(df.limit(0), df, 3, "id", "id", "v").count() == 0


def plain_census(records):
    """The counters of the census, record by record."""
    out = Counter()
    obj = lambda p, k: p.get(k) if isinstance(p, dict) and isinstance(p.get(k), dict) else None
    lst = lambda p, k: p.get(k) if isinstance(p, dict) and isinstance(p.get(k), list) else None
    txt = lambda p, k: p[k].strip() if isinstance(p, dict) and isinstance(p.get(k), str) and p[k].strip() else None

    def add(counter, *values):
        for v in values:
            out[counter, v] += 1
            out[counter, None] += 1

    def errors(check):
        for claim in lst(check, "claim_verifications") or []:
            add("claim_error", *[e for e in (lst(claim, "errors") or []) if isinstance(e, str) and e.strip()])

    for _, raw in records:
        try:
            r = json.loads(raw) if raw is not None else {}
        except ValueError:
            r = {}
        r = r if isinstance(r, dict) else {}
        add("record", "true")
        warnings = [w for w in (lst(r, "warnings") or []) if isinstance(w, str)]
        add("warning", *warnings)
        meta = obj(r, "metadata")
        failure, agent, context = obj(meta, "generation_failure"), obj(meta, "agent"), obj(meta, "context")
        if r.get("insufficient_evidence") is True:
            add("insufficient_evidence", "true")
        if "generator:model_error" in warnings:
            add("generator_model_error", "true")
            add("generation_failure_code", txt(failure, "failure_code") or "unclassified")
        for w, name in (("retrieval:model_error", "retrieval_model_error"), ("citation_verification_failed", "citation_failure")):
            if w in warnings:
                add(name, "true")
        add("stop_reason", txt(agent, "stop_reason") or "missing")
        strategy = r["retrieval_strategy"] if isinstance(r.get("retrieval_strategy"), str) else "missing"
        add("retrieval_strategy", strategy)
        recovery = obj(meta, "schema_recovery") or obj(failure, "schema_recovery")
        issues = lst(recovery, "issue_codes")
        issues = lst(failure, "schema_issue_codes") if issues is None else issues
        add("schema_issue", *[x for x in issues or [] if isinstance(x, str) and x.strip()])
        steps = {"schema_recovery": recovery, "missing_field_correction": obj(meta, "missing_field_correction") or obj(failure, "missing_field_correction"), "numeric_repair": obj(meta, "numeric_repair"), "claim_salvage": obj(meta, "claim_salvage")}
        tried = {k: bool(v) and v.get("attempted") is True for k, v in steps.items()}
        for k, v in steps.items():
            if tried[k]:
                add(k, txt(v, "outcome") or "missing")
        if tried["schema_recovery"]:
            add("schema_repair", *[x for x in lst(recovery, "repair_codes") or [] if isinstance(x, str) and x.strip()])
        if (check := obj(meta, "citation_verification")) is not None:
            add("verification_present", "true")
            if not tried["numeric_repair"]:
                errors(check)
        for k in ("numeric_repair", "claim_salvage"):
            if tried[k]:
                errors(obj(steps[k], "initial_verification"))
        trace = lst(context, "selection_trace")
        if trace is not None:
            add("context_trace_present", "true")
            add("selection_reason", *[t["reason"] for t in trace if isinstance(t, dict) and isinstance(t.get("reason"), str) and t["reason"].strip()])
        calls = [c for c in lst(agent, "tool_invocations") or [] if isinstance(c, dict) and c.get("tool_name") in batches.RETRIEVAL_TOOLS]
        add("tool_attempt", *[c["tool_name"] for c in calls])
        add("tool_success", *[c["tool_name"] for c in calls if c.get("success") is True])
        if any(c["tool_name"] == "graph_search" for c in calls):
            add("graph_touched", "true")
        if strategy == "graph":
            add("graph_final", "true")
    return out


def random_response(rng):
    pick = lambda *some: rng.choice(some)
    odd = lambda v: rng.choice([v, v, v, None, 3, "text", [], {}, True, ["x", 1]])
    step = lambda: {"attempted": odd(True), "outcome": odd(pick("succeeded", "failed", " salvage_succeeded ", " ")), "repair_codes": odd([pick("r1", "r2", " ", 5)]), "issue_codes": odd(["i1", 2]), "initial_verification": odd({"claim_verifications": odd([{"errors": odd(["e1", " ", "e2"])}, 7])})}
    meta = {k: odd(step()) for k in ("schema_recovery", "missing_field_correction", "numeric_repair", "claim_salvage") if rng.random() < 0.6}
    meta["generation_failure"] = odd({"failure_code": odd(pick("f1", " f2 ")), "schema_issue_codes": odd(["i3"]), "schema_recovery": odd(step()), "missing_field_correction": odd(step())})
    meta["agent"] = odd({"stop_reason": odd(pick("done", " stopped")), "total_latency_ms": odd(pick(1, 2.5, -4)), "tool_invocations": odd([{"tool_name": odd(pick("graph_search", "bm25_search", "other")), "success": odd(True)}, 4])})
    meta["context"] = odd({"selection_trace": odd([{"reason": odd(pick("top", "seed"))}, "x"]), "selected_count": odd(pick(2, 0, 2.5)), "estimated_token_count": odd(90)})
    if rng.random() < 0.5:
        meta["citation_verification"] = odd({"claim_verifications": odd([{"errors": odd(["c1", "c2"])}])})
    return {"answer": odd(pick("", "a b", " x ")), "warnings": odd([pick("generator:model_error", "retrieval:model_error", "citation_verification_failed", "w", ""), 4]), "insufficient_evidence": odd(True), "retrieval_strategy": odd(pick("graph", "hybrid")), "citations": odd([1]), "metadata": odd(meta)}


def test_batch_census_of_nested_records(spark):
    rng = random.Random(8)
    records = [(f"q{i}", json.dumps(random_response(rng))) for i in range(600)] + [("null", None), ("odd", "{not json"), ("list", "[1]"), ("empty", "{}"), ("text", '"x"')]
    df = spark.createDataFrame(records, "question_id string, response string").withColumns({"value": F.lit("clash"), "counter": F.lit(1)})
    census = batches.batch_census(df)
    assert {(r["counter"], r["value"]): r["n"] for r in census.collect()} == plain_census(records)
    report = batches.census_report(census).first()
    n = plain_census(records)
    assert report.records == len(records) and report.numeric_repair_attempted == n["numeric_repair", None] == report.numeric_repair_succeeded + report.numeric_repair_failed
    assert report.numeric_repair_succeeded == n["numeric_repair", "succeeded"] + n["numeric_repair", "salvage_succeeded"] and report.warnings == ["context_selection_trace_partially_present", "citation_verification_metadata_partially_present"]
    by = batches.batch_census(df.withColumn("part", F.length("question_id")), by=("part",)).groupBy("counter", "value").agg(F.sum("n").alias("n"))
    assert {(r["counter"], r["value"]): r["n"] for r in by.collect()} == n
    loaded = [json.loads(r) for _, r in records[:600]]
    number = lambda v, kinds=(int, float): float(v) if isinstance(v, kinds) and not isinstance(v, bool) and v >= 0 else None
    sub = lambda r, k: r["metadata"].get(k) if isinstance(r.get("metadata"), dict) and isinstance(r["metadata"].get(k), dict) else {}
    values = {
        "latency_ms": [number(sub(r, "agent").get("total_latency_ms")) for r in loaded], "selected_count": [number(sub(r, "context").get("selected_count"), int) for r in loaded],
        "context_tokens": [number(sub(r, "context").get("estimated_token_count"), int) for r in loaded], "answer_chars": [float(len(r["answer"])) for r in loaded if isinstance(r["answer"], str)], "answer_words": [float(len(r["answer"].split())) for r in loaded if isinstance(r["answer"], str)],
    }
    got = {r["counter"]: r for r in batches.batch_measures(df).collect()}
    for k, v in values.items():
        s = sorted(x for x in v if x is not None)
        assert (got[k].n, got[k].p50, got[k].p95, got[k].max) == (len(s), s[round((len(s) - 1) * 0.5)], s[round((len(s) - 1) * 0.95)], s[-1]) and got[k].mean == pytest.approx(sum(s) / len(s))
    assert batches.batch_census(df.limit(0)).count() == 0 and batches.batch_measures(df.limit(0)).count() == 0


def test_batches_side_by_side(spark):
    base = {"answer": "x", "warnings": [], "citations": [1], "metadata": {"agent": {"stop_reason": "done", "total_latency_ms": 10}}}
    other = {**base, "warnings": ["citation_verification_failed"], "metadata": {"agent": {"total_latency_ms": 14.5}}}
    a = spark.createDataFrame([(i, json.dumps(base)) for i in range(4)] + [(4, None)], "q int, response string")
    b = spark.createDataFrame([(0, json.dumps(base)), (1, json.dumps(other)), (2, json.dumps({**base, "answer": "y"})), (3, json.dumps({**base, "citations": [], "insufficient_evidence": True})), (4, "{}")], "q int, response string")
    counts, changed = batches.compare_batches(a, b, "q")
    got = {(r["counter"], r["transition"]): r["n"] for r in counts.collect()}
    assert got == {("stop_reason", "done->done"): 3, ("stop_reason", "done->missing"): 1, ("stop_reason", "missing->missing"): 1, ("insufficient_evidence", "false->false"): 4, ("insufficient_evidence", "false->true"): 1, ("citation_failure", "false->false"): 4, ("citation_failure", "false->true"): 1, ("generator_model_error", "false->false"): 5, ("answer_changed", "false"): 4, ("answer_changed", "true"): 1}
    cases = {r.question_id: r for r in changed.collect()}
    assert {*cases} == {1, 2, 3} and cases[1].latency_delta_ms == 4.5 and cases[2].answer_changed and cases[3].candidate_citations == 0
    with pytest.raises(Exception, match="only one batch has question"):
        batches.compare_batches(a, b.limit(3), "q")[1].collect()


def test_fields_of_nested_json(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c": null}]}, "d": 2.5}',), ('{"a": "x"}',), (None,), ("nope",)], "j string")
    got = {(r.path, r.kind): r.n for r in batches.field_census(df, "j", 5).collect()}
    assert got == {("$", "OBJECT"): 2, ("$", "MISSING"): 1, ("$", "INVALID"): 1, ("$.a", "OBJECT"): 1, ("$.a", "STRING"): 1, ("$.d", "DECIMAL"): 1, ("$.a.b", "ARRAY"): 1, ("$.a.b[]", "BIGINT"): 1, ("$.a.b[]", "OBJECT"): 1, ("$.a.b[].c", "VOID"): 1}
