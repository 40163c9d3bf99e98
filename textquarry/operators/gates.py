"""Strict loads, scorers and gates: what must hold before results count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators import metrics


def refuse(problems: DataFrame, what: str) -> None:
    """ValueError with the first few rows if there are any."""
    if rows := problems.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


# --- strict loads ----------------------------------------------------------------------------------

def order_problems(asked: DataFrame, given: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, asked_pos, given_pos): keys that stand at another place, on one side only, or twice. Empty if both sides are the same list."""
    a, b = asked.select(key, F.col(pos).alias("asked_pos")), given.select(key, F.col(pos).alias("given_pos"))
    differ = a.join(b, key, "full").where(~F.col("asked_pos").eqNullSafe(F.col("given_pos"))).select(key, "asked_pos", "given_pos")
    twice = b.groupBy(key).agg(F.count("*").alias("n"), F.min("given_pos").alias("given_pos")).where("n > 1").select(key, F.lit(None).cast("int").alias("asked_pos"), "given_pos")
    return differ.union(twice).distinct()


def prefix_problems(questions: DataFrame, records: DataFrame, key: str, pos: str) -> DataFrame:
    """Records that aren't the ordered beginning of the questions: what a resumed batch refuses to go on from."""
    done = records.agg(F.count("*").alias("n"))
    first = questions.join(F.broadcast(done), F.col(pos) < F.col("n")).select(key, pos)
    return order_problems(first, records, key, pos)


def batch_problems(records: DataFrame, key: str, expected: int | None = None, line: str | None = None) -> DataFrame:
    """(problem, n) of a completed batch: blank lines, blank or repeated keys, another number of records than the manifest's."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    rows = records.where(F.trim(F.coalesce(F.col(line), F.lit(""))) != "") if line else records
    counts = rows.agg(F.count("*").alias("records"), F.count_if(blank).alias("blank_key"), (F.count(F.col(key)) - F.countDistinct(F.col(key))).alias("repeated_key"))
    if line:
        counts = counts.crossJoin(records.agg(F.count_if(F.trim(F.coalesce(F.col(line), F.lit(""))) == "").alias("blank_line")))  # one row each
    else:
        counts = counts.withColumn("blank_line", F.lit(0).cast("long"))
    found = F.array(*[F.struct(F.lit(p).alias("problem"), F.col(p).alias("n")) for p in ("blank_line", "blank_key", "repeated_key")])
    if expected is not None:
        found = F.concat(found, F.array(F.struct(F.lit("record_count").alias("problem"), F.abs(F.col("records") - expected).alias("n"))))
    return counts.select(F.explode(found).alias("p")).select("p.*").where("n > 0")


def artifact_set_problems(manifests: DataFrame, required: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """(artifact, problem) of manifests(artifact, records, checksum, stored_records, stored_checksum, source_checksum, source).

    Required artifacts without a manifest or with several; contents that differ from their manifest;
    sources that aren't in the set or have another checksum now; and counts other than the expected.
    """
    spark = manifests.sparkSession
    wanted = spark.createDataFrame([(a,) for a in required], "artifact string")
    missing = wanted.join(manifests, "artifact", "left_anti").select("artifact", F.lit("missing").alias("problem"))
    twice = manifests.groupBy("artifact").agg(F.count("*").alias("n")).where("n > 1").select("artifact", F.lit("several_manifests").alias("problem"))
    say = lambda cond, text: manifests.where(cond).select("artifact", F.lit(text).alias("problem"))
    records = say(~F.col("records").eqNullSafe(F.col("stored_records")), "record_count")
    payload = say(~F.col("checksum").eqNullSafe(F.col("stored_checksum")), "checksum")
    parents = manifests.select(F.col("artifact").alias("source"), F.col("checksum").alias("now"), F.lit(True).alias("known")).distinct()
    line = manifests.where("source is not null").join(parents, "source", "left")
    orphans = line.where("known is null").select("artifact", F.lit("unknown_source").alias("problem"))
    stale = line.where(F.col("known") & ~F.col("source_checksum").eqNullSafe(F.col("now"))).select("artifact", F.lit("source_changed").alias("problem"))
    out = missing.union(twice).union(records).union(payload).union(orphans).union(stale)
    if expected:
        sizes = spark.createDataFrame([*expected.items()], "artifact string, wanted long")
        out = out.union(manifests.join(sizes, "artifact").where("records <> wanted").select("artifact", F.lit("not_the_full_corpus")))
    return out.distinct()


# --- scorers ---------------------------------------------------------------------------------------

def warmup_scores(references: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per question and overall exact match, METEOR and ROUGE-L of answers(question_id, answer, pos) against references(question_id, reference_answer, pos).

    The answers must be those of the references, in their order; missing references are refused.
    """
    refuse(order_problems(references, answers, "question_id", "pos"), "answers aren't those of the references in their order")
    refuse(references.where("reference_answer is null").select("question_id"), "references are missing")
    pairs = references.select("question_id", "reference_answer").join(answers.select("question_id", "answer"), "question_id")
    em = pairs.select("question_id", metrics.exact_match(F.col("answer"), F.col("reference_answer")).alias("exact_match"), metrics.rouge_l_long(metrics.metric_tokens(F.col("answer")), metrics.metric_tokens(F.col("reference_answer"))).alias("rouge_l"))
    cases = em.join(metrics.meteor(pairs, "question_id", "answer", "reference_answer"), "question_id")
    total = cases.agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 9).alias(c) for c in ("exact_match", "meteor", "rouge_l")])
    return cases, total


def answer_level(claims: DataFrame, keys: list[str]) -> DataFrame:
    """One row over answers of claims(keys, human_label, predicted_supported, execution_error).

    An answer is valid if people find all its claims supported, kept if the verifier does; answers
    with an execution error are counted apart. Rates without a denominator are null.
    """
    answers = claims.groupBy(*keys).agg(F.every(F.col("human_label") == "supported").alias("valid"), F.every("predicted_supported").alias("kept"), F.max("execution_error").alias("failed"))
    count = lambda c: F.count_if(c & ~F.col("failed"))
    v, k = F.col("valid"), F.col("kept")
    out = answers.agg(
        F.count("*").alias("answers"), F.count_if(F.col("failed")).alias("execution_errors"), F.count_if(v).alias("gold_valid"),
        count(v & k).alias("valid_kept"), count(v & ~k).alias("valid_rejected"), count(~v & ~k).alias("invalid_caught"), count(~v & k).alias("invalid_escaped"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumns({"retention": share("valid_kept", "valid_rejected"), "catch": share("invalid_caught", "invalid_escaped")})


def tag_catch_rates(claims: DataFrame, tags: str, negative: Column, caught: Column) -> DataFrame:
    """(tag, n, caught, catch_rate) over negative claims; a claim counts for each of its tags."""
    tall = claims.where(negative).select(F.explode(tags).alias("tag"), caught.alias("c"))
    return tall.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("c")).alias("caught")).withColumn("catch_rate", F.col("caught") / F.col("n"))


def repeat_stability(first: DataFrame, second: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: claims of the first run, how many have the same label in the second; a missing one or a null against a value counts as unstable."""
    b = second.select(*keys, F.col(label).alias("__b"), F.lit(True).alias("__there"))
    both = first.select(*keys, label).join(b, keys, "left")
    same = F.coalesce("__there", F.lit(False)) & F.col(label).eqNullSafe(F.col("__b"))
    out = both.agg(F.count("*").alias("claims"), F.count_if(same).alias("stable"))
    return out.withColumns({"unstable": F.col("claims") - F.col("stable"), "is_stable": F.col("claims") == F.col("stable")})


# --- checkpoint gate -------------------------------------------------------------------------------

def checkpoint_gate(cases: DataFrame, slack: int = 2, length_ratio: float = 1.25, repetition: float = 0.3, duplicate_lines: float = 0.3, tolerance: float = -0.005) -> DataFrame:
    """One row: whether a candidate is safe and no worse than its base, with the reasons against it.

    cases(question_id, side, status, cap_without_eos, eos_emitted, generated_tokens, repeat_8gram_ratio,
    duplicate_line_ratio, rouge_l, meteor), side being candidate or base, a row for each question on
    each. Safety: no errors; counts within `slack` of the base's, lengths within `length_ratio` of
    its mean, and of its median with 64 tokens at least. Meaning: mean paired differences above
    `tolerance`, and at least one above zero. Scores are paired where both sides succeeded.
    """
    ok = F.col("status") == "success"
    per = cases.groupBy("side").agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.count_if("cap_without_eos").alias("caps"), F.count_if("eos_emitted").alias("ends"),
        F.count_if(F.col("repeat_8gram_ratio") >= repetition).alias("repeats"), F.count_if(F.col("duplicate_line_ratio") >= duplicate_lines).alias("lines"),
        F.avg("generated_tokens").alias("mean"), F.expr("percentile(generated_tokens, 0.5)").alias("median"),
    )
    side = lambda s: per.where(F.col("side") == s).drop("side").select(*[F.col(c).alias(f"{s}_{c}") for c in per.columns[1:]])
    scored = lambda s: cases.where((F.col("side") == s) & ok).select("question_id", F.col("rouge_l").alias(f"{s}_r"), F.col("meteor").alias(f"{s}_m"))
    deltas = scored("candidate").join(scored("base"), "question_id").select((F.col("candidate_r") - F.col("base_r")).alias("r"), (F.col("candidate_m") - F.col("base_m")).alias("m"))
    paired = deltas.agg(F.count("*").alias("pairs"), *[F.coalesce(F.round(F.avg(c), 9), F.lit(0.0)).alias(f"{n}_delta") for c, n in (("r", "rouge_l"), ("m", "meteor"))], *[F.coalesce(F.expr(f"percentile({c}, 0.5)"), F.lit(0.0)).alias(f"{n}_median_delta") for c, n in (("r", "rouge_l"), ("m", "meteor"))])
    row = side("candidate").crossJoin(side("base")).crossJoin(paired)  # one row each
    a, b = (lambda c: F.col(f"candidate_{c}")), (lambda c: F.col(f"base_{c}"))
    unsafe = F.array_compact(F.array(
        F.when(a("n") != b("n"), F.lit("case_count")), F.when(a("errors") > 0, F.lit("generation_errors")),
        *[F.when(a(c) > b(c) + slack, F.lit(name)) for c, name in (("caps", "cap_without_eos"), ("repeats", "repetition"), ("lines", "duplicate_lines"))],
        F.when(a("ends") < b("ends") - slack, F.lit("eos_emitted")), F.when(a("mean") > b("mean") * length_ratio, F.lit("mean_length")),
        F.when(a("median") > F.greatest(b("median") * length_ratio, b("median") + 64), F.lit("median_length")),
    ))
    worse = F.array_compact(F.array(
        F.when(F.col("rouge_l_delta") < tolerance, F.lit("rouge_l")), F.when(F.col("meteor_delta") < tolerance, F.lit("meteor")),
        F.when((F.col("rouge_l_delta") <= 0) & (F.col("meteor_delta") <= 0), F.lit("no_positive_signal")),
    ))
    out = row.withColumns({"safety_failures": unsafe, "semantic_failures": worse})
    return out.withColumn("eligible", (F.size("safety_failures") == 0) & (F.size("semantic_failures") == 0))
