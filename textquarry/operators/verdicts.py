"""Verdicts from structured assessments, and recovery of malformed answer objects."""

from __future__ import annotations

import copy
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _invalid(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("string")


def by_not_established(relations: Column, coverage: Column) -> Column:
    """As evidence.derive_verdict, with NOT_ESTABLISHED for what is insufficient."""
    return F.when(F.array_contains(relations, "CONFLICT"), F.lit("contradicted")).when((coverage != "COMPLETE") | F.array_contains(relations, "NOT_ESTABLISHED"), F.lit("insufficient")).otherwise(F.lit("supported"))


def by_relation(relation: Column) -> Column:
    return F.when(relation == "CONTRADICTS", F.lit("contradicted")).when(relation == "ENTAILS", F.lit("supported")).otherwise(F.lit("insufficient"))


def by_two_gates(contradicted: Column, established: Column) -> Column:
    """Both at once is an error."""
    return F.when(contradicted & established, _invalid("both contradicted and established")).when(contradicted, F.lit("contradicted")).when(established, F.lit("supported")).otherwise(F.lit("insufficient"))


def strict_conflict(same_proposition: Column, cannot_both: Column) -> Column:
    """True only if both hold; a conflict about different propositions is an error."""
    return F.when(cannot_both & ~same_proposition, F.raise_error(F.lit("a conflict without a shared proposition")).cast("boolean")).otherwise(same_proposition & cannot_both)


def override_to_contradicted(base: Column, conflict: Column) -> tuple[Column, Column]:
    """The final label, and whether it was overridden; a conflict only ever makes a label `contradicted`."""
    return F.when(conflict, F.lit("contradicted")).otherwise(base), conflict & (base != "contradicted")


# Fields of an answer object and its bounds.
TOP = {"insufficient_evidence", "claims", "warnings"}
CLAIM = {"text", "evidence_ids"}
MOST_CLAIMS = 20
EVIDENCE_ID = re.compile(r"E[1-9][0-9]*")


def _once(values: list) -> list:
    out: list = []
    for v in values:
        if v not in out:
            out.append(v)
    return out


def answer_problems(x: object) -> list[str]:
    """What keeps an object from being an answer: {insufficient_evidence: bool, claims: [{text, evidence_ids}], warnings: [str]}."""
    if not isinstance(x, dict):
        return ["not_an_object"]
    out = []
    if x.keys() - TOP:
        out.append("extra_fields")
    if not isinstance(x.get("insufficient_evidence"), bool):
        out.append("missing_field")
    claims, warnings = x.get("claims", []), x.get("warnings", [])
    if not isinstance(claims, list) or len(claims) > MOST_CLAIMS:
        out.append("bad_claims")
    else:
        for c in claims:
            if not isinstance(c, dict) or c.keys() != CLAIM or not isinstance(c["text"], str) or not c["text"].strip():
                out.append("bad_claim")
            elif not isinstance(c["evidence_ids"], list) or not c["evidence_ids"] or _once(c["evidence_ids"]) != c["evidence_ids"] or not all(isinstance(e, str) and EVIDENCE_ID.fullmatch(e) for e in c["evidence_ids"]):
                out.append("bad_evidence_ids")
    if not isinstance(warnings, list) or _once(warnings) != warnings or not all(isinstance(w, str) for w in warnings):
        out.append("bad_warnings")
    if not out and x["insufficient_evidence"] == bool(claims):
        out.append("state_mismatch")
    return _once(out)


def recover_answer(text: str | None) -> tuple[str, str | None, list[str]]:
    """Outcome (valid, recovered, failed), the object as JSON, repairs made. Only allow-listed changes of shape; claim texts stay as they are."""
    try:
        x = json.loads(text or "")
    except ValueError:
        return "failed", None, []
    if not answer_problems(x):
        return "valid", json.dumps(x, ensure_ascii=False), []
    if not isinstance(x, dict):
        return "failed", None, []
    x, repairs = copy.deepcopy(x), []

    def repair(code: str, when: bool) -> bool:
        if when and code not in repairs:
            repairs.append(code)
        return when

    if repair("removed_extra_fields", bool(x.keys() - TOP)):
        x = {k: v for k, v in x.items() if k in TOP}
    if repair("wrapped_claim", isinstance(x.get("claims"), dict)):
        x["claims"] = [x["claims"]]
    if isinstance(x.get("claims"), list):
        if repair("dropped_excess_claims", len(x["claims"]) > MOST_CLAIMS):
            x["claims"] = x["claims"][:MOST_CLAIMS]
        for i, c in enumerate(x["claims"]):
            if isinstance(c, dict):
                if repair("removed_claim_fields", bool(c.keys() - CLAIM)):
                    c = x["claims"][i] = {k: v for k, v in c.items() if k in CLAIM}
                ids = c.get("evidence_ids")
                if repair("wrapped_evidence_id", isinstance(ids, str) and bool(EVIDENCE_ID.fullmatch(ids))):
                    c["evidence_ids"] = [ids]
                elif repair("deduplicated_evidence_ids", isinstance(ids, list) and _once(ids) != ids):
                    c["evidence_ids"] = _once(ids)
    if repair("deduplicated_warnings", isinstance(x.get("warnings"), list) and _once(x["warnings"]) != x["warnings"]):
        x["warnings"] = _once(x["warnings"])
    if not repairs or answer_problems(x):
        return "failed", None, repairs
    return "recovered", json.dumps(x, ensure_ascii=False), repairs


RECOVERY = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("repairs", T.ArrayType(T.StringType()))])


@F.pandas_udf(RECOVERY)
def recover_answers(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([recover_answer(x) for x in s], columns=["outcome", "answer", "repairs"])


def overridden(df: DataFrame, base: str, same: str, cannot: str) -> DataFrame:
    label, changed = override_to_contradicted(F.col(base), strict_conflict(F.col(same), F.col(cannot)))
    return df.withColumn("label", label).withColumn("overridden", changed)
