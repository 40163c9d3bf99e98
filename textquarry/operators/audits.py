"""Audits of corpora, candidate pools and paired runs: clusters of copies, styles, churn, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.cleaning import composed


def folded(text: Column) -> Column:
    """For comparisons: small letters, single blanks, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def _keyed(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(kind, key, id): a digest of each key that isn't blank, so that texts aren't shuffled."""
    cells = [F.struct(F.lit(kind).alias("kind"), F.when(F.coalesce(c, F.lit("")).rlike(r"(?U)\S"), F.sha2(c, 256)).alias("key")) for kind, c in keys.items()]
    return df.select(F.col(id_col).alias("id"), F.inline(F.array(*cells))).where("key is not null").select("kind", "key", "id")


def duplicate_clusters(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(kind, clusters, records, share): of each key, the values that several rows have, those rows, and their percentage of all rows. Blank and null keys have no copies."""
    sizes = _keyed(df, id_col, keys).groupBy("kind", "key").agg(F.count("*").alias("n"))
    per = sizes.groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("records"))
    total = df.agg(F.count("*").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("kind", "clusters", "records", (F.col("records") * 100.0 / F.col("all")).alias("share"))  # one row


def largest_clusters(df: DataFrame, id_col: str, keys: dict[str, Column], most: int = 5, sample: int = 5) -> DataFrame:
    """(kind, place, size, ids): the largest clusters of each key, with their smallest ids. Clusters of one size stand by their smallest id."""
    rows = _keyed(df, id_col, keys)
    sizes = rows.groupBy("kind", "key").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1")
    top = sizes.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("size"), "first"))).where(F.col("place") <= most)
    held = rows.join(F.broadcast(top.select("kind", "key", "place", "size")), ["kind", "key"])  # `most` rows a kind
    held = held.withColumn("r", F.row_number().over(Window.partitionBy("kind", "place").orderBy("id"))).where(F.col("r") <= sample)
    return held.groupBy("kind", "place", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("ids"))


def style_profile(df: DataFrame, text_col: str) -> DataFrame:
    """One row: texts by the line ends they have (crlf, lf, cr, mixed, none), and those that Unicode composition changes. Null texts count as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.replace(t, F.lit("\r\n"), F.lit(""))
    crlf, lf, cr = (F.contains(a, F.lit(b)) for a, b in ((t, "\r\n"), (rest, "\n"), (rest, "\r")))
    style = F.when(crlf & (lf | cr), "mixed").when(crlf, "crlf").when(lf, "lf").when(cr, "cr").otherwise("none")
    marked = df.select(style.alias("style"), (composed(t) != t).alias("changes"))
    return marked.agg(F.count("*").alias("texts"), *[F.count_if(F.col("style") == s).alias(s) for s in ("crlf", "lf", "cr", "mixed", "none")], F.count_if("changes").alias("not_composed"))


def largest_documents(df: DataFrame, id_col: str, text_col: str, most: int = 20) -> DataFrame:
    """(id, chars, words) of the longest texts, ties by id."""
    words = F.size(F.filter(F.split(text_col, r"(?U)\s+"), lambda w: w != ""))
    full = df.where(F.col(text_col).rlike(r"(?U)\S"))
    top = full.select(F.col(id_col).alias("id"), F.length(text_col).alias("chars"), words.alias("words"))
    return top.orderBy(F.desc("chars"), "id").limit(most)


# --- candidate pools --------------------------------------------------------------------------------

def pool_audit(candidates: DataFrame, shallow: int = 20, deep: int = 40, k: int = 8, bucket: int = 5) -> DataFrame:
    """One row a query: what its best k become when its pool grows from the first `shallow` fused candidates to the first `deep`.

    candidates(query_id, chunk_id, document_id, fused_rank, score). Both lists are cut from one
    scoring, ties by fused rank and id. entrants are in the deep list only, displaced in the shallow
    one; buckets counts entrants by fused rank, `bucket` ranks at a time; margin is the lowest
    entrant's score less the highest displaced one's, null without either.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank", "chunk_id")
    near = Window.partitionBy("query_id", F.col("fused_rank") <= shallow).orderBy(F.desc("score"), "fused_rank", "chunk_id")
    df = candidates.where(F.col("fused_rank") <= deep).withColumn("score", F.round("score", 8))
    df = df.withColumn("deep_rank", F.row_number().over(order)).withColumn("near_rank", F.row_number().over(near))
    a, b = (F.col("fused_rank") <= shallow) & (F.col("near_rank") <= k), F.col("deep_rank") <= k
    df = df.withColumn("a", a).withColumn("b", b).where("a or b")
    new, gone = F.col("b") & ~F.col("a"), F.col("a") & ~F.col("b")
    steps = -(-(deep - shallow) // bucket)
    name = lambda i: f"{shallow + i * bucket + 1}-{min(shallow + (i + 1) * bucket, deep)}"
    inside = lambda i: new & (F.ceil((F.col("fused_rank") - shallow) / bucket) == i + 1)
    docs = lambda c: F.collect_set(F.when(c, F.col("document_id")))  # noqa: E731 - k values
    out = df.groupBy("query_id").agg(
        F.every(F.col("a") & F.col("b") & (F.col("near_rank") == F.col("deep_rank"))).alias("identical"), F.count_if(F.col("a") & F.col("b")).alias("overlap"), F.count("*").alias("all"), F.count_if(new).alias("entrants"), F.count_if(gone).alias("displaced"),
        F.size(F.array_except(docs(F.col("b")), docs(F.col("a")))).alias("new_documents"), F.min(F.when(F.col("a"), F.col("score"))).alias("shallow_cutoff"), F.min(F.when(F.col("b"), F.col("score"))).alias("deep_cutoff"),
        F.round(F.min(F.when(new, F.col("score"))) - F.max(F.when(gone, F.col("score"))), 8).alias("margin"), F.create_map(*[x for i in range(steps) for x in (F.lit(name(i)), F.count_if(inside(i)))]).alias("buckets"),
    )
    return out.withColumn("jaccard", F.col("overlap") / F.col("all")).drop("all")


def pool_summary(audit: DataFrame) -> DataFrame:
    """One row over the queries of a pool_audit: how many changed, entrants in all and by bucket, and the spread of overlap, Jaccard, cutoffs and margins."""
    spread = lambda c, name, places=4: [F.round(F.avg(c), places).alias(f"{name}_mean"), F.round(F.median(c), places).alias(f"{name}_median"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    changed = F.when(~F.col("identical"), F.col("entrants"))
    row = audit.agg(
        F.count("*").alias("cases"), F.count_if("identical").alias("identical_cases"), F.count_if(~F.col("identical")).alias("changed_cases"), F.coalesce(F.sum("entrants"), F.lit(0)).alias("entrants"), F.count_if(F.col("entrants") > 0).alias("cases_with_entrants"), F.coalesce(F.sum("new_documents"), F.lit(0)).alias("new_documents"),
        *spread(changed, "changed_entrants"), *spread(F.col("overlap"), "overlap"), *spread(F.col("jaccard"), "jaccard"), F.round(F.avg("shallow_cutoff"), 8).alias("shallow_cutoff_mean"), F.round(F.avg("deep_cutoff"), 8).alias("deep_cutoff_mean"), F.round(F.avg("margin"), 8).alias("margin_mean"),
    )
    return row


def entrant_buckets(audit: DataFrame) -> DataFrame:
    """(bucket, entrants) over the queries of a pool_audit."""
    return audit.select(F.explode("buckets").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("entrants"))


# --- paired runs ------------------------------------------------------------------------------------

def paired_runs(base: DataFrame, treatment: DataFrame, references: DataFrame) -> DataFrame:
    """The answers of two runs beside the references: question_id, base_answer, treatment_answer, reference, base_hit_max, treatment_hit_max.

    base and treatment: (question_id, answer, status, hit_max); references(question_id, reference).
    A reference that lacks an answer in a run, and an answer whose generation failed, stop the job.
    """
    side = lambda d, p: d.select("question_id", *[F.col(c).alias(f"{p}_{c}") for c in ("answer", "status", "hit_max")])
    df = references.where("reference is not null").join(side(base, "base"), "question_id", "left").join(side(treatment, "treatment"), "question_id", "left")
    good = lambda p: (F.col(f"{p}_status") == "success") & ~F.startswith(F.coalesce(f"{p}_answer", F.lit("")), F.lit("GENERATION_ERROR:"))
    fault = F.when(F.col("base_answer").isNull() | F.col("treatment_answer").isNull(), F.lit("no answer to ")).when(~F.coalesce(good("base") & good("treatment"), F.lit(False)), F.lit("failed generation for "))
    stop = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("question_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return df.where(stop).drop("base_status", "treatment_status")


def paired_report(scored: DataFrame, scores: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, cases, base_mean, treatment_mean, mean_delta, median_delta, win, tie, loss) of scored(question_id, base_<score>, treatment_<score>)."""
    delta = lambda s: F.col(f"treatment_{s}") - F.col(f"base_{s}")
    tall = scored.select(F.inline(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(f"base_{s}").cast("double").alias("a"), F.col(f"treatment_{s}").cast("double").alias("b"), delta(s).cast("double").alias("d")) for s in scores])))
    return tall.groupBy("metric").agg(
        F.count("*").alias("cases"), F.avg("a").alias("base_mean"), F.avg("b").alias("treatment_mean"), F.avg("d").alias("mean_delta"), F.median("d").alias("median_delta"),
        F.count_if(F.col("d") > tolerance).alias("win"), F.count_if(F.abs("d") <= tolerance).alias("tie"), F.count_if(F.col("d") < -tolerance).alias("loss"),
    )


def length_report(runs: DataFrame, most_censored: float = 0.02) -> DataFrame:
    """One row over paired_runs: mean lengths, answers that ended at the token limit, and warnings; more than `most_censored` of a run at the limit may be censored."""
    n = lambda c: F.avg(F.length(c))
    hit = lambda p: F.count_if(F.coalesce(F.col(f"{p}_hit_max"), F.lit(False)))
    row = runs.agg(F.count("*").alias("cases"), n("base_answer").alias("base_chars"), n("treatment_answer").alias("treatment_chars"), n("reference").alias("reference_chars"), hit("base").alias("base_hits"), hit("treatment").alias("treatment_hits"))
    row = row.withColumn("chars_delta", F.col("treatment_chars") - F.col("base_chars"))
    said = [F.when(F.col(f"{p}_hits") > 0, F.concat(F.lit(f"{p}_generations_hit_max_tokens_count_"), F.col(f"{p}_hits").cast("string"))) for p in ("base", "treatment")]
    censored = reduce(lambda a, b: a | b, [F.col(f"{p}_hits") / F.col("cases") > most_censored for p in ("base", "treatment")])
    return row.withColumn("warnings", F.array_compact(F.array(*said, F.when(censored, F.lit("screening_potentially_censored")))))


# --- frozen labels ----------------------------------------------------------------------------------

def freeze_problems(packets: DataFrame, reviews: DataFrame, keys: list[str], text_col: str, labels: list[str]) -> DataFrame:
    """(keys, problem): what keeps reviews from being frozen as the labels of packets.

    packets(keys, text); reviews(keys, label, text_sha256). Both must have the same keys, each once;
    a review is bound to the text that it was made of by its SHA-256, and its label is one of `labels`.
    """
    say = lambda d, problem: d.select(*keys, F.lit(problem).alias("problem"))
    twice = lambda d: d.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    bound = reviews.join(packets.select(*keys, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__sha")), keys)
    out = [
        say(packets.join(reviews, keys, "left_anti"), "unreviewed_packet"), say(reviews.join(packets, keys, "left_anti"), "review_without_packet"), say(twice(packets), "repeated_packet"), say(twice(reviews), "repeated_review"),
        say(bound.where(~F.col("text_sha256").eqNullSafe(F.col("__sha"))), "text_changed"), say(reviews.where(~F.coalesce(F.col("label").isin(*labels), F.lit(False))), "unknown_label"),
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


def frozen_classes(reviews: DataFrame, labels: list[str]) -> DataFrame:
    """(label, n) for each of `labels`, with 0 for those that no review has."""
    row = reviews.agg(*[F.count_if(F.col("label") == x).alias(f"n{i}") for i, x in enumerate(labels)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"n{i}").alias("n")) for i, x in enumerate(labels)])))
