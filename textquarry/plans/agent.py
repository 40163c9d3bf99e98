"""The bounded answer loop over tables of queries: tools behind a registry, attempts, verification and repair.

Every step runs once for all queries that need it, as one plan; an attempt's outcomes are written to
the shared scratch folder, and only queries that are still open go on to the next.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators import evidence, vectors
from textquarry.session import materialize

# Kinds of errors, whether another attempt may help, and the reasons a run ends for.
RETRYABLE = {
    "invalid_input": False, "tool_not_registered": False, "tool_contract_error": False, "configuration_error": False, "dataset_schema_error": False, "data_validation_error": False,
    "artifact_compatibility_error": False, "backend_initialization_error": False, "retrieval_error": True, "model_error": True, "timeout": True, "external_service_error": True,
}
STOP_REASONS = ("answer_verified", "max_retry_reached", "no_new_strategy", "non_retryable_tool_error", "timeout", "generation_failed", "citation_verification_failed")
#: What fails in a job, a plan or on the machine is no outcome of a query, whoever called for it.
JOB_ERRORS = (PySparkException, Py4JError, OSError, MemoryError)


class ToolFailure(Exception):
    """A tool's refusal of a whole batch, with its kind."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


@dataclass(frozen=True)
class Tool:
    """A step over a table: run(requests) gives one row for each query_id with `outputs`, and may set `error` in a row."""

    name: str
    inputs: str  #: DDL of the columns it needs beside query_id; a request with a null in one of them is refused
    outputs: str  #: DDL of the columns it gives
    run: Callable[[DataFrame], DataFrame]
    timeout_seconds: float = math.inf  #: for the whole batch, whose time grows with its rows and with what is searched


def _types(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields}


class Registry:
    """Tools by name. What a tool does wrong the rows say; a failed job is raised.

    strict: for tools of our own, whose mistakes are no outcomes. A batch that can't be asked for, a
    tool's exception but ToolFailure, a late batch, and rows that break the contract are raised too.
    """

    def __init__(self, tools: list[Tool], strict: bool = False):
        if len({t.name for t in tools}) != len(tools):
            raise ValueError("a tool is registered twice")
        self.tools, self.strict = {t.name: t for t in tools}, strict

    def invoke(self, name: str, requests: DataFrame, outputs: str = "") -> DataFrame:
        """(query_id, outputs, error): `error` is null or a key of RETRYABLE. `outputs` names the columns wanted where the tool isn't registered."""
        tool = self.tools.get(name)
        wanted = T._parse_datatype_string(tool.outputs if tool else outputs or "__none int")
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name != "__none"]

        def failed(rows: DataFrame, kind: str | Column) -> DataFrame:
            return rows.select("query_id", *nulls, (F.lit(kind) if isinstance(kind, str) else kind).alias("error"))

        def refused(rows: DataFrame, kind: str) -> DataFrame:
            if self.strict:
                raise ToolFailure(kind, f"{name}: {kind}")
            return failed(rows, kind)

        if tool is None:
            return refused(requests, "tool_not_registered")
        needs = T._parse_datatype_string(tool.inputs) if tool.inputs else T.StructType([])
        have = _types(requests.schema)
        if any(have.get(f.name) != f.dataType.simpleString() for f in needs.fields):
            return refused(requests, "invalid_input")
        whole = F.lit(True)
        for f in needs.fields:
            whole = whole & F.col(f.name).isNotNull()
        good, bad = requests.where(whole), failed(requests.where(~whole), "invalid_input")
        began = time.monotonic()
        try:
            given = tool.run(good)
        except ToolFailure as e:
            return failed(good, e.kind if e.kind in RETRYABLE else "tool_contract_error").union(bad)
        except JOB_ERRORS:
            raise
        except Exception:  # noqa: BLE001 - a tool's own error is an outcome of its rows
            if self.strict:
                raise
            return failed(good, "tool_contract_error").union(bad)
        have = _types(given.schema)
        if any(have.get(f.name) != f.dataType.simpleString() for f in [*wanted.fields, requests.schema["query_id"]]):
            return refused(good, "tool_contract_error").union(bad)
        error = F.col("error").cast("string") if "error" in have else F.lit(None).cast("string")
        rows = materialize(given.select("query_id", *[f.name for f in wanted.fields], error.alias("error")), f"tool-{name}")
        if time.monotonic() - began > tool.timeout_seconds:
            return refused(good, "timeout").union(bad)
        once = rows.join(rows.groupBy("query_id").agg(F.count("*").alias("__n")).where("__n = 1"), "query_id", "left_semi")
        known = good.select("query_id").join(once, "query_id")
        lacking = good.select("query_id").join(once, "query_id", "left_anti")
        kind = F.when(F.col("error").isNull() | F.col("error").isin(*RETRYABLE), F.col("error")).otherwise(F.lit("tool_contract_error"))
        told = known.select("query_id", *[f.name for f in wanted.fields], kind.alias("error")).union(failed(lacking, "tool_contract_error"))
        if self.strict and not told.where("error = 'tool_contract_error'").isEmpty():
            raise ToolFailure("tool_contract_error", f"{name}: rows that are lacking, repeated or of an unknown error")
        return told.union(bad)


def _retryable(error: Column) -> Column:
    return error.isin(*[k for k, v in RETRYABLE.items() if v])


HITS = "hits array<struct<evidence_id:string,chunk_id:string,text:string>>"
GENERATION = "answer string, citation_ids array<string>, insufficient boolean"
VERIFICATION = "is_valid boolean, can_repair boolean, can_salvage boolean, retained long, salvaged string"


def run_agent(queries: DataFrame, variants: DataFrame, registry: Registry, max_retry: int = 2, rewrite: bool = True) -> DataFrame:
    """(query_id, attempt, strategy, asked, answer, stop_reason, outcome, warnings): one row a query.

    queries(query_id, question, routes): the ordered searches to try, of which max_retry + 1 count.
    variants(query_id, variant_id, text): rewritten questions; each later attempt takes the first
    that its query hasn't asked. An attempt retrieves by its route's tool and grades the evidence.
    If it is sufficient the query ends in this attempt: the answer is generated and verified, and, if
    it fails by numbers or negations only, salvaged or generated once more. If it isn't, or a
    retryable error came up, the query goes on. outcome: verified, salvaged, regenerated or abstained.
    """
    asked = F.col("question")
    live = queries.select("query_id", "question", F.slice("routes", 1, max_retry + 1).alias("routes"), asked.alias("asked"), F.array(F.lower(F.trim(asked))).alias("used"), F.array().cast("array<string>").alias("warnings"))
    ends = live.where(F.size("routes") == 0)
    if not ends.isEmpty():
        raise ValueError("a query has no route")
    ended: list[DataFrame] = []

    def end(rows: DataFrame, attempt: int, reason: Column, outcome: Column, answer: Column) -> None:
        ended.append(rows.select("query_id", F.lit(attempt).alias("attempt"), "strategy", "asked", answer.alias("answer"), reason.alias("stop_reason"), outcome.alias("outcome"), F.array_distinct("warnings").alias("warnings")))

    none, abstained = F.lit(None).cast("string"), F.lit("abstained")
    warn = lambda c: F.array_compact(F.concat("warnings", F.array(c)))
    for attempt in range(1, max_retry + 2):
        if attempt > 1 and rewrite:
            fresh = live.select("query_id", "used").join(variants, "query_id").where(~F.array_contains("used", F.lower(F.trim("text"))))
            first = fresh.groupBy("query_id").agg(F.min_by("text", "variant_id").alias("next"))
            live = live.join(first, "query_id", "left")
            live = live.withColumns({"asked": F.coalesce("next", "asked"), "used": F.array_compact(F.concat("used", F.array(F.lower(F.trim("next"))))), "warnings": warn(F.when(F.col("next").isNull(), F.lit("query_rewrite_unchanged")))}).drop("next")
        live = materialize(live.withColumn("strategy", F.element_at("routes", attempt)), "open")
        found = None
        for name in sorted(r.strategy for r in live.select("strategy").distinct().collect()):  # as many as there are kinds of search
            one = registry.invoke(name, live.where(F.col("strategy") == name).select("query_id", "asked"), HITS)
            one = one.select("query_id", "hits", F.col("error").alias("search_error"))
            found = one if found is None else found.union(one)
        graded = registry.invoke("context_grading", found.where("search_error is null").join(live.select("query_id", "asked"), "query_id").select("query_id", "asked", "hits"), "is_sufficient boolean")
        state = live.join(found, "query_id").join(graded.select("query_id", "is_sufficient", F.col("error").alias("grade_error")), "query_id", "left")
        error = F.coalesce("search_error", "grade_error")
        state = state.withColumn("error", error).withColumn("warnings", warn(F.when(error.isNotNull(), F.concat(F.when(F.col("search_error").isNotNull(), F.lit("retrieval:")).otherwise(F.lit("grader:")), error)).when(~F.col("is_sufficient"), F.lit("insufficient_context"))))
        state = materialize(state, "attempt")
        stops = (F.col("error") == "timeout") | ~_retryable(F.col("error"))
        end(state.where(F.col("error").isNotNull() & stops), attempt, F.when(F.col("error") == "timeout", F.lit("timeout")).otherwise(F.lit("non_retryable_tool_error")), abstained, none)
        ready = state.where("error is null and is_sufficient").select("query_id", "question", "asked", "strategy", "hits", "warnings")
        ended.append(_generate_and_verify(ready, registry, attempt))
        on = state.where(F.col("error").isNull() & ~F.col("is_sufficient") | F.col("error").isNotNull() & ~stops)
        last = F.size("routes") <= attempt
        end(on.where(last), attempt, F.lit("max_retry_reached" if attempt >= max_retry + 1 else "no_new_strategy"), abstained, none)
        live = materialize(on.where(~last).select("query_id", "question", "routes", "asked", "used", "warnings"), "open")
        if live.isEmpty():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.union(part)
    return out


def _generate_and_verify(ready: DataFrame, registry: Registry, attempt: int) -> DataFrame:
    """What becomes of queries with sufficient evidence."""

    def generate(rows: DataFrame, correction: str) -> DataFrame:
        asked = rows.select("query_id", "asked", "hits", F.lit(correction).alias("correction"))
        return registry.invoke("answer_generation", asked, GENERATION).withColumnRenamed("error", "generation_error")

    def verify(rows: DataFrame) -> DataFrame:
        return registry.invoke("citation_verification", rows.select("query_id", "answer", "citation_ids", "hits"), VERIFICATION).withColumnRenamed("error", "verification_error")

    made = ready.join(generate(ready, "none"), "query_id")
    written = materialize(made, "written")
    can = written.where("generation_error is null and not insufficient")
    first = written.join(verify(can), "query_id", "left")
    first = materialize(first, "verified")
    repairable = first.where("verification_error is null and not is_valid and (can_salvage or can_repair)")
    salvage = repairable.where("retained > 0").select("query_id", F.col("salvaged").alias("answer"), "citation_ids", "hits")
    again = verify(salvage).select("query_id", F.col("is_valid").alias("salvage_valid"), F.col("verification_error").alias("salvage_error"))
    state = materialize(first.join(again, "query_id", "left"), "salvaged")
    open_ = state.where("verification_error is null and not is_valid and can_repair and salvage_error is null and not coalesce(salvage_valid, false)")
    second = generate(open_.select("query_id", "asked", "hits"), "numeric_mismatch")
    second = second.select("query_id", F.col("answer").alias("answer2"), F.col("citation_ids").alias("citations2"), F.col("insufficient").alias("insufficient2"), F.col("generation_error").alias("generation_error2"))
    second = materialize(open_.select("query_id", "hits").join(second, "query_id"), "second")
    third = verify(second.where("generation_error2 is null and not insufficient2").select("query_id", F.col("answer2").alias("answer"), F.col("citations2").alias("citation_ids"), "hits"))
    third = third.select("query_id", F.col("is_valid").alias("valid2"), F.col("verification_error").alias("verification_error2"))
    state = state.join(second.drop("hits"), "query_id", "left").join(third, "query_id", "left")

    c = F.col
    tried = c("generation_error2").isNotNull() | c("insufficient2").isNotNull()
    timeout = F.coalesce(c("generation_error") == "timeout", F.lit(False)) | F.coalesce(c("verification_error") == "timeout", F.lit(False)) | F.coalesce(c("salvage_error") == "timeout", F.lit(False))
    timeout = timeout | F.coalesce(c("generation_error2") == "timeout", F.lit(False)) | F.coalesce(c("verification_error2") == "timeout", F.lit(False))
    outcome = F.when(c("is_valid"), F.lit("verified")).when(c("salvage_valid"), F.lit("salvaged")).when(c("valid2"), F.lit("regenerated")).otherwise(F.lit("abstained"))
    reason = (
        F.when(outcome != "abstained", F.lit("answer_verified")).when(timeout, F.lit("timeout"))
        .when(c("generation_error").isNotNull() | c("insufficient"), F.lit("generation_failed"))
        .when(tried & (c("generation_error2").isNotNull() | F.coalesce("insufficient2", F.lit(False))), F.lit("generation_failed"))
        .otherwise(F.lit("citation_verification_failed"))
    )
    said = F.array(
        F.when(c("generation_error").isNotNull(), F.concat(F.lit("generator:"), "generation_error")).when(c("insufficient"), F.lit("generator:insufficient_evidence")),
        F.when(c("verification_error").isNotNull(), F.concat(F.lit("verifier:"), "verification_error")),
        F.when(outcome.isin("salvaged", "regenerated"), F.lit("repair_succeeded")), F.when(reason == "citation_verification_failed", F.lit("citation_verification_failed")),
    )
    answer = F.when(outcome == "verified", c("answer")).when(outcome == "salvaged", c("salvaged")).when(outcome == "regenerated", c("answer2"))
    return state.select("query_id", F.lit(attempt).alias("attempt"), "strategy", "asked", answer.alias("answer"), reason.alias("stop_reason"), outcome.alias("outcome"), F.array_distinct(F.array_compact(F.concat("warnings", said))).alias("warnings"))


def verification_tool(**limits) -> Tool:
    """The rule verifier as a tool: claims against the evidence they mark, with what repair may do."""

    def run(requests: DataFrame) -> DataFrame:
        answers = requests.select(F.col("query_id").alias("question_id"), "answer", "citation_ids")
        ev = requests.select(F.col("query_id").alias("question_id"), F.explode("hits").alias("h")).select("question_id", "h.evidence_id", "h.text")
        claims = materialize(evidence.verify_claims(answers, ev, **limits), "claims")
        whole = claims.groupBy("question_id").agg(F.every("supported").alias("is_valid"))
        joined = whole.join(evidence.repair_gates(claims), "question_id").join(evidence.salvage_claims(claims).select("question_id", "retained", F.col("answer").alias("salvaged")), "question_id")
        missing = answers.select("question_id").join(whole, "question_id", "left_anti")
        empty = missing.select("question_id", F.lit(False).alias("is_valid"), F.lit(False).alias("can_repair"), F.lit(False).alias("can_salvage"), F.lit(0).cast("long").alias("retained"), F.lit("").alias("salvaged"))
        return joined.select("question_id", "is_valid", "can_repair", "can_salvage", "retained", "salvaged").union(empty).withColumnRenamed("question_id", "query_id")

    return Tool("citation_verification", "answer string, citation_ids array<string>, hits array<struct<evidence_id:string,chunk_id:string,text:string>>", VERIFICATION, run)


def grading_tool(minimum: int = 1, least_overlap: float = 0.0) -> Tool:
    """Evidence is sufficient with `minimum` items, of which one shares the given part of the question's terms."""
    from textquarry.functions.text import content_terms

    def run(requests: DataFrame) -> DataFrame:
        q = content_terms(F.col("asked"))
        best = F.array_max(F.transform("hits", lambda h: F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_terms(h["text"]))) / F.size(q)).otherwise(F.lit(0.0))))
        return requests.select("query_id", ((F.size("hits") >= minimum) & (F.coalesce(best, F.lit(0.0)) >= least_overlap)).alias("is_sufficient"))

    return Tool("context_grading", "asked string, hits array<struct<evidence_id:string,chunk_id:string,text:string>>", "is_sufficient boolean", run)


def extraction_tool(most: int = 3) -> Tool:
    """Answers by extraction: the first line of each of the first `most` items, with its mark."""

    def run(requests: DataFrame) -> DataFrame:
        used = F.slice("hits", 1, most)
        line = lambda h: F.concat(F.trim(F.element_at(F.split(F.trim(h["text"]), r"\R"), 1)), F.lit(" ["), h["evidence_id"], F.lit("]"))
        return requests.select("query_id", F.array_join(F.transform(used, line), "\n").alias("answer"), F.transform(used, lambda h: h["evidence_id"]).alias("citation_ids"), (F.size("hits") == 0).alias("insufficient"))

    return Tool("answer_generation", "asked string, hits array<struct<evidence_id:string,chunk_id:string,text:string>>", GENERATION, run)


def search_tools(corpus, limits, strategies: tuple[str, ...] = ("bm25", "dense", "hybrid", "hybrid_rerank")) -> list[Tool]:
    """A tool for each search strategy over a corpus; hits are numbered evidence."""
    from textquarry.plans import retrieval

    def tool(name: str) -> Tool:
        def run(requests: DataFrame) -> DataFrame:
            found = retrieval.search(requests.select("query_id", F.col("asked").alias("question"), F.lit(None).cast("string").alias("rewritten")), corpus, (name,), limits)
            hits = vectors.late_materialise(found, corpus.texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), "text"))).alias("h"))
            numbered = F.transform("h", lambda x: F.struct(F.concat(F.lit("E"), x["rank"]).alias("evidence_id"), x["chunk_id"].alias("chunk_id"), x["text"].alias("text")))
            return requests.select("query_id").join(hits.select("query_id", numbered.alias("hits")), "query_id", "left").select("query_id", F.coalesce("hits", F.array().cast("array<struct<evidence_id:string,chunk_id:string,text:string>>")).alias("hits"))

        return Tool(name, "asked string", HITS, run)

    return [tool(s) for s in strategies]
