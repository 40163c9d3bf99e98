import json

import pytest
from pyspark.sql import functions as F

from textquarry.operators import diagnostics, evidence, verdicts


def test_verdicts(spark):
    df = spark.createDataFrame([(["ENTAIL", "CONFLICT"], "COMPLETE"), (["ENTAIL"], "PARTIAL"), (["INSUFFICIENT"], "COMPLETE"), (["ENTAIL"], "COMPLETE")], "r array<string>, c string")
    assert [x[0] for x in df.select(evidence.derive_verdict(F.col("r"), F.col("c"))).collect()] == ["contradicted", "insufficient", "insufficient", "supported"]
    gates = spark.createDataFrame([(True, False), (False, True), (False, False)], "x boolean, y boolean")
    assert [x[0] for x in gates.select(verdicts.by_two_gates(F.col("x"), F.col("y"))).collect()] == ["contradicted", "supported", "insufficient"]
    with pytest.raises(Exception, match="both contradicted"):
        spark.sql("select true x, true y").select(verdicts.by_two_gates(F.col("x"), F.col("y"))).collect()
    with pytest.raises(Exception, match="shared proposition"):
        spark.sql("select false x, true y").select(verdicts.strict_conflict(F.col("x"), F.col("y"))).collect()


def test_recovery_changes_shape_only():
    good = {"insufficient_evidence": False, "claims": [{"text": "a", "evidence_ids": ["E1"]}], "warnings": []}
    assert verdicts.recover_answer(json.dumps(good))[0] == "valid"
    odd = {**good, "x": 1, "claims": {"text": "a", "evidence_ids": "E1", "y": 2}, "warnings": ["w", "w"]}
    outcome, text, repairs = verdicts.recover_answer(json.dumps(odd))
    assert outcome == "recovered" and json.loads(text) == {**good, "warnings": ["w"]}
    assert repairs == ["removed_extra_fields", "wrapped_claim", "removed_claim_fields", "wrapped_evidence_id", "deduplicated_warnings"]
    for bad in (None, "", "[1]", '{"claims": 3}', json.dumps({**good, "insufficient_evidence": True})):
        assert verdicts.recover_answer(bad)[0] == "failed"


def test_gates_and_checkpoints(spark):
    c = spark.createDataFrame([("b", 0.5, 10.0), ("x", 0.3, 9.0), ("y", 0.6, None), ("z", 0.49, 10.5)], "candidate_id string, q double, ms double")
    goals = {"q": ("max", 0.2, 0.05), "ms": ("min", None, 1.0)}
    got = {r.candidate_id: r.reasons for r in diagnostics.gate_candidates(c, goals, "b").collect()}
    assert got == {"b": [], "x": ["objective_regression_failed:q"], "y": ["objective_metric_missing:ms"], "z": []}
    assert all("regression_baseline_ineligible" in r.reasons or r.reasons for r in diagnostics.gate_candidates(c, goals, "y").collect())
    k = spark.createDataFrame([(1, True, 0.1, 0, 1, 2.0), (2, True, 0.1, 0, 0, 3.0), (3, False, 0.9, 0, 0, 1.0)], "step int, eligible boolean, gain double, unended int, repetitive int, loss double")
    assert [r.step for r in diagnostics.rank_checkpoints(k).orderBy("rank").collect()] == [2, 1]
