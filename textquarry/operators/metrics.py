"""Retrieval, answer and verifier metrics as set-at-a-time queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import let

METRIC_TOKEN = r"[\p{L}\p{N}]+"


def ranking_metrics(hits: DataFrame, grades: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(case_id, k, recall, precision, ndcg, reciprocal_rank): hits(case_id, target_id, rank), grades(case_id, target_id, grade).

    A target that is found twice counts at its best rank, and ranks close up. Precision divides by
    k. Cases are those with grades; cases without hits score 0.
    """
    once = hits.groupBy("case_id", "target_id").agg(F.min("rank").alias("rank"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "target_id")))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    found = ranked.join(grades, ["case_id", "target_id"]).select("case_id", "r", (gain / F.log2(F.col("r") + 1)).alias("dcg"))
    ideal = grades.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "target_id"))).withColumn("idcg", gain / F.log2(F.col("r") + 1))
    ks = lambda c, v: [F.sum(F.when(F.col("r") <= k, v).otherwise(0.0)).alias(f"{c}_{k}") for k in cutoffs]
    f = found.groupBy("case_id").agg(*ks("n", F.lit(1.0)), *ks("dcg", F.col("dcg")), F.min("r").alias("first"))
    i = ideal.groupBy("case_id").agg(*ks("idcg", F.col("idcg")), F.count("*").alias("relevant"))
    both = i.join(f, "case_id", "left").na.fill(0.0)
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col(f"n_{k}") / F.col("relevant")).alias("recall"), (F.col(f"n_{k}") / k).alias("precision"), F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0).alias("ndcg"))
        for k in cutoffs
    ])
    rr = F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0)
    return both.select("case_id", rr.alias("reciprocal_rank"), F.explode(rows).alias("m")).select("case_id", "m.*", "reciprocal_rank")


def normalise_answer(text: Column) -> Column:
    """White space collapsed and case folded; give texts in form C."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def metric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalise_answer(text), F.lit(METRIC_TOKEN), F.lit(0))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalise_answer(prediction) == normalise_answer(reference)).cast("double")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays, as a fold: one row of the table for each predicted token."""
    return let(prediction, lambda p: let(reference, lambda r: _rouge_l(p, r)))


def _rouge_l(prediction: Column, reference: Column) -> Column:
    zero = F.transform(reference, lambda x: F.lit(0))

    def row(prev, token):
        start = F.struct(F.expr("cast(array() as array<int>)").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("diag"))

        def cell(acc, pair):
            value = F.when(pair["t"] == token, acc["diag"] + 1).otherwise(F.greatest(acc["left"], pair["p"]))
            return F.struct(F.concat(acc["row"], F.array(value)).alias("row"), value.alias("left"), pair["p"].alias("diag"))

        pairs = F.zip_with(reference, prev, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
        return F.aggregate(pairs, start, cell)["row"]

    lcs = F.coalesce(F.element_at(F.aggregate(prediction, zero, row), -1), F.lit(0))
    p, r = lcs / F.size(prediction), lcs / F.size(reference)
    return F.when((F.size(prediction) == 0) | (F.size(reference) == 0) | (lcs == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


@F.pandas_udf(T.DoubleType())
def rouge_l_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for long texts: bit-parallel longest common subsequence of two token arrays."""

    def one(x, y):
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        where: dict = {}
        for i, t in enumerate(y):
            where[t] = where.get(t, 0) | 1 << i
        full = (1 << len(y)) - 1
        v = full
        for t in x:
            u = v & where.get(t, 0)
            v = ((v + u) | (v - u)) & full
        n = len(y) - bin(v).count("1")
        return 2 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def meteor(pairs: DataFrame, id_col: str, prediction: str, reference: str) -> DataFrame:
    """(id, meteor): exact tokens; the k-th occurrence of a token aligns with its k-th occurrence in the reference."""

    def tall(col: str, name: str) -> DataFrame:
        x = pairs.select(F.col(id_col).alias("id"), F.posexplode(metric_tokens(F.col(col))).alias(name, "token"))
        return x.withColumn("occ", F.row_number().over(Window.partitionBy("id", "token").orderBy(name)))

    matched = tall(prediction, "pp").join(tall(reference, "rp"), ["id", "token", "occ"])
    w = Window.partitionBy("id").orderBy("pp")
    gap = F.coalesce(((F.col("pp") != F.lag("pp").over(w) + 1) | (F.col("rp") != F.lag("rp").over(w) + 1)).cast("int"), F.lit(1))
    per = matched.withColumn("gap", gap).groupBy("id").agg(F.count("*").alias("m"), F.sum("gap").alias("chunks"))
    sizes = pairs.select(F.col(id_col).alias("id"), F.size(metric_tokens(F.col(prediction))).alias("np"), F.size(metric_tokens(F.col(reference))).alias("nr"))
    p, r = F.col("m") / F.col("np"), F.col("m") / F.col("nr")
    value = p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * F.pow(F.col("chunks") / F.col("m"), 3))
    return sizes.join(per, "id", "left").select(F.col("id").alias(id_col), F.coalesce(value, F.lit(0.0)).alias("meteor"))


def citation_metrics(expected: Column, actual: Column) -> tuple[Column, Column]:
    """Precision and recall of citation ids; null where none are expected."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    correct = F.size(F.array_intersect(e, a))
    return F.when(F.size(e) > 0, F.when(F.size(a) > 0, correct / F.size(a)).otherwise(0.0)), F.when(F.size(e) > 0, correct / F.size(e))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at index round((n - 1) * fraction), halves to even, of an array; null if empty."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(s) > 0, F.element_at(s, (F.bround((F.size(s) - 1) * F.lit(fraction)) + 1).cast("int")))


def macro_summary(long: DataFrame) -> DataFrame:
    """(metric, value) rows to their mean and count over non-null values."""
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("cases"))


def binary_metrics(df: DataFrame, label: Column, prediction: Column, groups: list[str] = ()) -> DataFrame:
    """Confusion counts, precision, retention (recall), catch (specificity), F1, balanced accuracy; null where a denominator is 0. A null prediction is wrong."""
    p = F.coalesce(prediction, ~label)
    agg = df.groupBy(*groups).agg(F.count_if(label & p).alias("tp"), F.count_if(~label & p).alias("fp"), F.count_if(~label & ~p).alias("tn"), F.count_if(label & ~p).alias("fn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    agg = agg.withColumns({"precision": ratio("tp", tp + fp), "retention": ratio("tp", tp + fn), "catch": ratio("tn", tn + fp), "accuracy": F.try_divide((tp + tn).cast("double"), (tp + fp + tn + fn).cast("double"))})
    return agg.withColumns({"f1": F.try_divide(2 * F.col("precision") * F.col("retention"), F.col("precision") + F.col("retention")), "balanced_accuracy": (F.col("retention") + F.col("catch")) / 2})


def confusion_matrix(df: DataFrame, label: str, prediction: str, values: list[str]) -> DataFrame:
    return df.groupBy(label).pivot(prediction, values).count().na.fill(0)


def paired_correctness(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """One row: both right, only a, only b, neither, net. A missing prediction is wrong."""
    ra, rb = F.coalesce(F.col(a) == F.col(label), F.lit(False)), F.coalesce(F.col(b) == F.col(label), F.lit(False))
    return df.agg(F.count_if(ra & rb).alias("both"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"), F.count_if(~ra & ~rb).alias("neither"), (F.count_if(~ra & rb) - F.count_if(ra & ~rb)).alias("net_delta"))


def paired_deltas(base: DataFrame, candidate: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: cases, mean delta, improved, regressed, tied."""
    joined = base.select(key, F.col(value).alias("a")).join(candidate.select(key, F.col(value).alias("b")), key).withColumn("d", F.col("b") - F.col("a"))
    return joined.agg(F.count("*").alias("cases"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > tolerance).alias("improved"), F.count_if(F.col("d") < -tolerance).alias("regressed"), F.count_if(F.abs("d") <= tolerance).alias("tied"))
