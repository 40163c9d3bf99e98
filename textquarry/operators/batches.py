"""Censuses and comparisons of answer batches: nested JSON records, read as variants in one pass.

A record is an id and its response as JSON. Its fields may be missing, null or of another kind
anywhere; what isn't of the kind asked for counts as missing, never as an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators import ranks

# Warnings with a counter of their own.
GENERATOR_ERROR, RETRIEVAL_ERROR, CITATION_FAILURE = "generator:model_error", "retrieval:model_error", "citation_verification_failed"
# The tools that count as retrieval, and the outcomes that count as success of a step.
RETRIEVAL_TOOLS = ("bm25_search", "dense_search", "hybrid_search", "rerank_search", "graph_search")
SUCCESS = {"schema_recovery": ("succeeded",), "missing_field_correction": ("succeeded",), "numeric_repair": ("salvage_succeeded", "model_regeneration_succeeded", "succeeded"), "claim_salvage": ("succeeded",)}
MISSING = "missing"


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_kind(v: Column, kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^(?:{kinds})"), F.lit(False))


def text_at(v: Column, path: str, stripped: bool = True) -> Column:
    """A string that isn't blank, without white space around; null for all else."""
    found = F.when(is_kind(get(v, path), "STRING"), F.try_variant_get(v, path, "string"))
    if not stripped:
        return found
    trimmed = F.regexp_replace(found, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def number_at(v: Column, path: str, kinds: str = "BIGINT|DECIMAL|DOUBLE|FLOAT") -> Column:
    """A number of 0 or more; null for all else, true and false among it."""
    found = F.when(is_kind(get(v, path), kinds), F.try_variant_get(v, path, "double"))
    return F.when(found >= 0, found)


def flag_at(v: Column, path: str) -> Column:
    """Whether true stands there; anything else is false."""
    return F.coalesce(F.when(is_kind(get(v, path), "BOOLEAN"), F.try_variant_get(v, path, "boolean")), F.lit(False))


def list_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def strings_of(values: Column, blanks: bool = False) -> Column:
    """The strings among an array of variants, blank ones only if asked for; an empty array for null."""
    found = F.filter(F.coalesce(values, F.array().cast("array<variant>")), lambda x: is_kind(x, "STRING"))
    found = F.transform(found, lambda x: F.try_variant_get(x, "$", "string"))
    return found if blanks else F.filter(found, lambda x: x.rlike(r"(?U)\S"))


def _rows(counter: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(counter).alias("counter"), x.cast("string").alias("value")))


def _row(counter: str, value: Column, where: Column | None = None) -> Column:
    one = F.array(F.struct(F.lit(counter).alias("counter"), value.cast("string").alias("value")))
    return one if where is None else F.when(where, one).otherwise(F.array().cast("array<struct<counter:string,value:string>>"))


def _claim_errors(verification: Column, path: str) -> Column:
    claims = F.coalesce(list_at(verification, f"{path}.claim_verifications"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(claims, lambda c: strings_of(list_at(c, "$.errors"))))


def outcome_rows(r: Column) -> Column:
    """(counter, value) rows of one response: every counter of the census."""
    warnings = strings_of(list_at(r, "$.warnings"), blanks=True)
    has = lambda w: F.array_contains(warnings, w)
    at = "$.metadata"
    recovery = F.when(is_kind(get(r, f"{at}.schema_recovery"), "OBJECT"), get(r, f"{at}.schema_recovery")).otherwise(get(r, f"{at}.generation_failure.schema_recovery"))
    correction = F.when(is_kind(get(r, f"{at}.missing_field_correction"), "OBJECT"), get(r, f"{at}.missing_field_correction")).otherwise(get(r, f"{at}.generation_failure.missing_field_correction"))
    steps = {"schema_recovery": recovery, "missing_field_correction": correction, "numeric_repair": get(r, f"{at}.numeric_repair"), "claim_salvage": get(r, f"{at}.claim_salvage")}
    tried = {name: flag_at(step, "$.attempted") for name, step in steps.items()}
    issues = F.coalesce(list_at(recovery, "$.issue_codes"), list_at(r, f"{at}.generation_failure.schema_issue_codes"))
    verified = is_kind(get(r, f"{at}.citation_verification"), "OBJECT")
    trace = list_at(r, f"{at}.context.selection_trace")
    reasons = F.filter(F.transform(F.coalesce(trace, F.array().cast("array<variant>")), lambda t: text_at(t, "$.reason", stripped=False)), lambda x: x.rlike(r"(?U)\S"))
    calls = F.coalesce(list_at(r, f"{at}.agent.tool_invocations"), F.array().cast("array<variant>"))
    tools = F.filter(F.transform(calls, lambda c: F.struct(text_at(c, "$.tool_name", stripped=False).alias("tool"), flag_at(c, "$.success").alias("ok"))), lambda c: c["tool"].isin(*RETRIEVAL_TOOLS))
    strategy = F.coalesce(text_at(r, "$.retrieval_strategy", stripped=False), F.lit(MISSING))
    true = F.lit("true")
    parts = [
        _row("record", true), _rows("warning", warnings), _row("insufficient_evidence", true, flag_at(r, "$.insufficient_evidence")),
        _row("generator_model_error", true, has(GENERATOR_ERROR)), _row("generation_failure_code", F.coalesce(text_at(r, f"{at}.generation_failure.failure_code"), F.lit("unclassified")), has(GENERATOR_ERROR)),
        _row("retrieval_model_error", true, has(RETRIEVAL_ERROR)), _row("citation_failure", true, has(CITATION_FAILURE)),
        _row("stop_reason", F.coalesce(text_at(r, f"{at}.agent.stop_reason"), F.lit(MISSING))), _row("retrieval_strategy", strategy),
        _rows("schema_issue", strings_of(issues)), _rows("schema_repair", F.when(tried["schema_recovery"], strings_of(list_at(recovery, "$.repair_codes"))).otherwise(F.array().cast("array<string>"))),
        *[_row(name, F.coalesce(text_at(step, "$.outcome"), F.lit(MISSING)), tried[name]) for name, step in steps.items()],
        _row("verification_present", true, verified),
        # a repaired answer's claims are those of before the repair
        _rows("claim_error", F.when(tried["numeric_repair"], _claim_errors(steps["numeric_repair"], "$.initial_verification")).otherwise(F.when(verified, _claim_errors(r, f"{at}.citation_verification")).otherwise(F.array().cast("array<string>")))),
        _rows("claim_error", F.when(tried["claim_salvage"], _claim_errors(steps["claim_salvage"], "$.initial_verification")).otherwise(F.array().cast("array<string>"))),
        _row("context_trace_present", true, trace.isNotNull()), _rows("selection_reason", reasons),
        _rows("tool_attempt", F.transform(tools, lambda c: c["tool"])), _rows("tool_success", F.transform(F.filter(tools, lambda c: c["ok"]), lambda c: c["tool"])),
        _row("graph_touched", true, F.exists(tools, lambda c: c["tool"] == "graph_search")), _row("graph_final", true, strategy == "graph"),
    ]
    return F.concat(*parts)


def measure_rows(r: Column) -> Column:
    """(counter, value) rows of the numbers of one response; a missing one has none."""
    answer = text_at(r, "$.answer", stripped=False)
    words = F.size(F.filter(F.split(answer, r"(?U)\s+"), lambda w: w != ""))
    at = {
        "latency_ms": number_at(r, "$.metadata.agent.total_latency_ms"), "selected_count": number_at(r, "$.metadata.context.selected_count", "BIGINT"),
        "context_tokens": number_at(r, "$.metadata.context.estimated_token_count", "BIGINT"), "answer_chars": F.length(answer).cast("double"), "answer_words": words.cast("double"),
    }
    return F.filter(F.array(*[F.struct(F.lit(k).alias("counter"), v.alias("value")) for k, v in at.items()]), lambda x: x["value"].isNotNull())


def _read(records: DataFrame, response_col: str) -> DataFrame:
    return records.withColumn("__r", F.try_parse_json(F.col(response_col).cast("string")))


def batch_census(records: DataFrame, response_col: str = "response", by: tuple[str, ...] = ()) -> DataFrame:
    """by, counter, value, n: how often each value of each counter occurs; a null value is the counter's total.

    One pass: a record becomes the rows of all its counters, which are counted by value and by
    counter together. A response that is null or no JSON object counts as a record whose fields are
    all missing.
    """
    rows = _read(records, response_col).select(*by, F.inline(outcome_rows(F.col("__r"))))
    keys = [*by, "counter", "value"]
    return rows.groupingSets([[*by, "counter", "value"], [*by, "counter"]], *keys).agg(F.count("*").alias("n"))


def batch_measures(records: DataFrame, response_col: str = "response", by: tuple[str, ...] = ()) -> DataFrame:
    """by, counter, n, mean, p50, p95, max of the records' numbers, percentiles by nearest rank; a counter that no record has has no row."""
    rows = _read(records, response_col).select(*by, F.inline(measure_rows(F.col("__r"))))
    keys = [*by, "counter"]
    found = ranks.exact_ranks(rows, keys, "value", {"p50": ranks.nearest(0.5), "p95": ranks.nearest(0.95), "max": lambda n: n - 1})
    means = rows.groupBy(*keys).agg(F.avg("value").alias("mean")).withColumnsRenamed({k: f"__{k}" for k in keys})
    return found.join(means, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).select(*keys, "n", "mean", "p50", "p95", "max")


def census_report(census: DataFrame) -> DataFrame:
    """One row from a census without `by`: records, steps that were tried, that succeeded and that failed, and the report's warnings."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_, total = lambda name: F.col("counter") == name, F.col("value").isNull()
    cols = [n(is_(name) & total).alias(out) for name, out in (("record", "records"), ("insufficient_evidence", "insufficient"), ("verification_present", "verified"), ("citation_failure", "citation_failures"), ("context_trace_present", "traces"), ("graph_touched", "graph_touched"), ("graph_final", "graph_final"))]
    for name, good in SUCCESS.items():
        cols += [n(is_(name) & total).alias(f"{name}_attempted"), n(is_(name) & F.col("value").isin(*good)).alias(f"{name}_succeeded"), n(is_(name) & ~total & ~F.col("value").isin(*good)).alias(f"{name}_failed")]
    row = census.agg(*cols)
    partly = F.when(F.col("traces") == 0, F.lit("context_selection_trace_not_present")).when(F.col("traces") != F.col("records"), F.lit("context_selection_trace_partially_present"))
    return row.withColumn("warnings", F.array_compact(F.array(partly, F.when(F.col("verified") != F.col("records"), F.lit("citation_verification_metadata_partially_present")))))


OUTCOMES = ("stop_reason", "insufficient_evidence", "citation_failure", "generator_model_error")


def outcomes(records: DataFrame, id_col: str, response_col: str = "response") -> DataFrame:
    """(question_id, answer_sha256, stop_reason, insufficient_evidence, citation_failure, generator_model_error, citations, latency_ms)."""
    df, r = _read(records, response_col), F.col("__r")
    warnings = strings_of(list_at(r, "$.warnings"), blanks=True)
    return df.select(
        F.col(id_col).alias("question_id"), F.sha2(F.coalesce(text_at(r, "$.answer", stripped=False), F.lit("")), 256).alias("answer_sha256"), F.coalesce(text_at(r, "$.metadata.agent.stop_reason"), F.lit(MISSING)).alias("stop_reason"),
        flag_at(r, "$.insufficient_evidence").cast("string").alias("insufficient_evidence"), F.array_contains(warnings, CITATION_FAILURE).cast("string").alias("citation_failure"), F.array_contains(warnings, GENERATOR_ERROR).cast("string").alias("generator_model_error"),
        F.coalesce(F.size(list_at(r, "$.citations")), F.lit(0)).alias("citations"), number_at(r, "$.metadata.agent.total_latency_ms").alias("latency_ms"),
    )


def paired_outcomes(base: DataFrame, candidate: DataFrame, id_col: str, response_col: str = "response") -> DataFrame:
    """Both batches' outcomes side by side (base_*, candidate_*), with answer_changed, latency_delta_ms and changed. Questions that one batch lacks are refused."""
    a, b = (outcomes(d, id_col, response_col) for d in (base, candidate))
    names = [c for c in a.columns if c != "question_id"]
    side = lambda d, p: d.select("question_id", F.lit(True).alias(f"__{p}"), *[F.col(c).alias(f"{p}_{c}") for c in names])
    both = side(a, "base").join(side(b, "candidate"), "question_id", "full")
    lacking = F.col("__base").isNull() | F.col("__candidate").isNull()
    both = both.where(F.when(lacking, F.raise_error(F.concat(F.lit("only one batch has question "), F.col("question_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    differs = reduce(lambda x, y: x | y, [F.col(f"base_{c}") != F.col(f"candidate_{c}") for c in (*OUTCOMES, "citations")])
    both = both.withColumn("answer_changed", F.col("base_answer_sha256") != F.col("candidate_answer_sha256")).withColumn("latency_delta_ms", F.col("candidate_latency_ms") - F.col("base_latency_ms"))
    return both.withColumn("changed", F.col("answer_changed") | differs).drop("__base", "__candidate", "base_answer_sha256", "candidate_answer_sha256")


def compare_batches(base: DataFrame, candidate: DataFrame, id_col: str, response_col: str = "response") -> tuple[DataFrame, DataFrame]:
    """(counter, transition, n) of the four outcomes and of changed answers, `a->b`; and the changed cases."""
    both = paired_outcomes(base, candidate, id_col, response_col)
    moves = [F.struct(F.lit(c).alias("counter"), F.concat_ws("->", f"base_{c}", f"candidate_{c}").alias("transition")) for c in OUTCOMES]
    moves.append(F.struct(F.lit("answer_changed").alias("counter"), F.col("answer_changed").cast("string").alias("transition")))
    counts = both.select(F.inline(F.array(*moves))).groupBy("counter", "transition").agg(F.count("*").alias("n"))
    return counts, both.where("changed").drop("changed")


def field_census(df: DataFrame, json_col: str, depth: int = 8) -> DataFrame:
    """(path, kind, n): every field of nested JSON down to `depth` levels, with the kinds of its values; `[]` stands for any place of an array.

    A text that is no JSON is one field `$` of the kind INVALID; null is MISSING. Each level is one
    explosion of the level above, ended where no object or array is left.
    """
    v = F.try_parse_json(F.col(json_col))
    kind = lambda c: F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0)
    own = F.when(F.col(json_col).isNull(), F.lit("MISSING")).when(v.isNull(), F.lit("INVALID")).otherwise(kind(v))
    level = df.select(F.lit("$").alias("path"), own.alias("kind"), v.alias("v"))
    out = level.groupBy("path", "kind").agg(F.count("*").alias("n"))
    for _ in range(depth):
        parts = F.when(F.col("kind") == "ARRAY", F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.struct(F.lit("[]").alias("key"), x.alias("value"))))
        parts = parts.when(F.col("kind") == "OBJECT", F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda x: F.struct(F.concat(F.lit("."), x["key"]).alias("key"), x["value"].alias("value"))))
        level = level.select("path", F.inline(parts)).select(F.concat("path", "key").alias("path"), kind(F.col("value")).alias("kind"), F.col("value").alias("v"))
        out = out.unionByName(level.groupBy("path", "kind").agg(F.count("*").alias("n")))
    return out
