"""Dataset engineering: duplicate groups, leakage-aware splits, deterministic samples, censuses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.functions.text import let, ngrams
from textquarry.operators.groups import among
from textquarry.operators.setjoin import SIGNATURE, Sections, SetJoinParams, linked, shingled, signature
from textquarry.session import discard, materialize, shuffles_freed


def normalise_question(text: Column) -> Column:
    """Case folded; runs of anything but letters and digits are one space. Give texts in form C."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def exact_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(norm, n, pairs, first_id) of texts that occur more than once."""
    g = df.select(F.col(id_col).alias("id"), normalise_question(F.col(text_col)).alias("norm")).groupBy("norm").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return g.where("n > 1").select("norm", "n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), "first_id")


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.92, anchors: int = 8, most: int = 200) -> DataFrame:
    """(a, b, similarity): pairs of different normalised texts that share one of their rarest shingles.

    Three-word shingles, the whole text if shorter; each text's `anchors` rarest shingles, ties by
    SHA-256, are its anchors; an anchor of more than `most` texts is no candidate source, which is
    the method's definition. Pairs are confirmed on full sets. One text stands for its exact copies.

    A shingle travels as the first 16 bytes of its SHA-256, in whose order ties go anyway. What only
    one text holds comes before all that several hold and leads to no pair: it is but counted, and
    only shared shingles are ranked. The shuffles of all shingles are larger than the texts, so they
    go by ROUNDS classes of first words, one after the other, each of which is freed before the next;
    a text takes its rarest shingles so far, and the number of those it shares, from class to class.
    Texts whose numbers of shingles alone rule the threshold out don't meet; sets are made again of
    the texts that do, and texts of no pair stay where they are.
    """
    texts = df.select(F.col(id_col).alias("id"), normalise_question(F.col(text_col)).alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    spark = df.sparkSession
    with shuffles_freed(spark):
        texts = materialize(texts.withColumn("n", F.size(_shingles(F.col("norm")))), "texts")
        digest = F.substring(F.unhex(F.sha2("s", 256)), 1, 16)
        own, new = Window.partitionBy("id"), F.col("held").isNull()
        best = None
        for k in range(ROUNDS):
            tall = texts.select("id", "copies", "n", F.explode(_shingles(F.col("norm"), k)).alias("s")).select("id", "copies", "n", digest.alias("g")).repartition("g")
            several = tall.groupBy("g").agg(F.sum("copies").alias("f"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("g", "f")
            rows = tall.join(several.hint("shuffle_hash"), "g").withColumn("held", F.lit(None).cast("long"))  # both sides read one shuffle
            rows = rows.unionByName(best.drop("r")) if best else rows
            held = F.coalesce(F.max("held").over(own), F.lit(0)) + F.count_if(new).over(own)
            rows = rows.select("id", "copies", "n", "g", "f", held.alias("held"), F.row_number().over(own.orderBy("f", "g")).alias("r")).where(F.col("r") <= anchors)
            before, best = best, materialize(rows, "anchors")
            if before:
                discard(before)
        anchored = best.where(F.col("n") - F.col("held") + F.col("r") <= anchors)
        usable = anchored.groupBy("g").agg(F.sum("copies").alias("m")).where((F.col("m") <= most) & (F.col("m") > 1)).select("g")
        kept = materialize(anchored.join(usable, "g", "left_semi").select("id", "g", "n"), "kept")
        sizes_fit = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-6
        pairs = kept.select(F.col("id").alias("a"), F.col("n").alias("na"), "g").join(kept.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g"), "g").where((F.col("a") < F.col("b")) & sizes_fit).select("a", "b").distinct()
        pairs = materialize(pairs, "pairs")
        met = among(texts.select("id", "norm"), pairs.select(F.explode(F.array("a", "b")).alias("id")))
        met = materialize(met, "met")
        both = pairs.join(met.select(F.col("id").alias("a"), F.col("norm").alias("ta")), "a").join(met.select(F.col("id").alias("b"), F.col("norm").alias("tb")), "b")
        same = let(_shingles(F.col("ta")), lambda x: let(_shingles(F.col("tb")), lambda y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))
        found = materialize(both.select("a", "b", same.alias("similarity")).where(F.col("similarity") >= threshold), "near")
    discard(texts, best, kept, pairs, met)
    return found


#: Classes of shingles that are shuffled one after the other.
ROUNDS = 8


def _shingles(norm: Column, k: int | None = None) -> Column:
    """Distinct three-word shingles, the whole text if shorter; k: those whose first word is of this class, with no others made."""
    if k is None:
        return F.array_distinct(ngrams(F.split(norm, " "), 3))
    of = lambda w: F.pmod(F.xxhash64(w), F.lit(ROUNDS)) == k
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.size(w) - 2), lambda i: of(F.element_at(w, i)))
    few = lambda w: F.filter(F.array(F.array_join(w, " ")), lambda _: of(F.element_at(w, 1)))
    return F.array_distinct(let(F.split(norm, " "), lambda w: F.when(F.size(w) < 3, few(w)).otherwise(F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, 3), " ")))))


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.92) -> DataFrame:
    """(id, group_id): components over exact and near duplicates; the group is its smallest id.

    Near duplicates are all pairs of normalised texts whose sets of three-word shingles, the whole
    text if shorter, reach the threshold; blank texts are duplicates of each other. Nothing but the
    sets decides: every pair that may link is compared or joined already (operators/setjoin.py).
    """
    percent = Fraction(str(threshold)) * 100
    p = SetJoinParams(shingle=3, percent=math.floor(percent))
    norm = normalise_question(F.col(text_col))
    named = df.select(F.col(id_col).alias("id"), norm.alias("text"), F.xxhash64(norm).alias("th"))
    fields = T.StructType([*named.select("id", "th").schema.fields, *T._parse_datatype_string(SIGNATURE).fields])
    types = [to_arrow_type(f.dataType) for f in fields.fields[2:]]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sections, shingles = Sections(p), _Shingles(p.shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds the memory of a worker
                part = batch.slice(at, 512)
                columns = signature([shingles(t) for t in part.column(2).to_pylist()], sections)
                columns[1] = [BLANK if d is None else d for d in columns[1]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, columns, types)], names=fields.names)

    sig = materialize(named.select("id", "th", "text").mapInArrow(signed, fields), "sig")
    found = linked(sig, named, p, _Shingles(p.shingle), p.percent if p.percent == percent else percent)
    return found.select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("group_id"))


#: Stands for the digest of the set of a blank text.
BLANK = b"blank"


class _Shingles:
    """Hashes of the distinct k-word shingles of normalised texts; those of words are kept for the next texts."""

    def __init__(self, k: int, entries: int = 400_000):
        self.k, self.entries, self.known = k, entries, {}

    def __call__(self, norm: str) -> np.ndarray:
        import xxhash

        words = norm.split(" ") if norm else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.k:
            return np.array([xxhash.xxh64_intdigest(norm, seed=len(words))], np.uint64)
        known = self.known
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.entries:
            known.clear()
        return shingled(hashes, self.k)


def quarantine(groups: DataFrame, holdout: DataFrame) -> DataFrame:
    """Training ids whose group holds a holdout id. groups(id, group_id, is_holdout)."""
    held = groups.where("is_holdout").select("group_id").distinct()
    return groups.where("not is_holdout").join(held, "group_id", "left_semi") if holdout is None else groups.join(held, "group_id", "left_semi").join(holdout, "id", "left_anti")


def _group_order(groups: DataFrame, seed: int) -> DataFrame:
    """(group_id, n, h): a group's size, and the SHA-256 of the seed and its sorted ids, joined.

    Ids come to their group's task sorted, and the digest is carried from one Arrow batch to the
    next, so that a group of any size is never held.
    """
    kind = groups.schema["group_id"].dataType.simpleString()
    rows = groups.select("group_id", F.col("id").cast("string").alias("id"))
    rows = rows.repartition("group_id").sortWithinPartitions("group_id", F.asc_nulls_first("id"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        group, n, h, first = None, 0, None, True
        for batch in batches:
            done = []
            for g, i in zip(batch.column(0), batch.column(1).to_pylist()):
                if h is None or g != group:
                    if h is not None:
                        done.append((group, n, h.hexdigest()))
                    group, n, h, first = g, 0, hashlib.sha256(f"{seed}:".encode()), True
                n += 1
                if i is not None:
                    h.update(("" if first else "|").encode() + i.encode())
                    first = False
            if done:
                yield emit(done, batch)
        if h is not None:
            yield emit([(group, n, h.hexdigest())], None)

    def emit(done: list, batch) -> pa.RecordBatch:
        groups, sizes, hashes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array([g.as_py() for g in groups], groups[0].type), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], names=["group_id", "n", "h"])

    return rows.mapInArrow(digest, f"group_id {kind}, n long, h string")


def _before(sizes: DataFrame, buckets: int = 256) -> DataFrame:
    """Adds `before`: the running total of n ahead of a row in the order of h, without one task for all rows.

    Totals of hash ranges are accumulated first (a fixed number of rows); within a range, a window.
    """
    b = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    marked = sizes.withColumn("b", b)
    totals = marked.groupBy("b").agg(F.sum("n").alias("t"))
    ahead = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.join(F.broadcast(ahead), "b").withColumn("before", F.col("base") + inner).drop("b", "base")  # at most `buckets` rows


def group_split(groups: DataFrame, fraction: float = 0.15, seed: int = 2026) -> DataFrame:
    """(id, group_id, part): whole groups go to `dev`, in the order of a salted hash, until it holds round(n * fraction) ids; the rest is `train`."""
    total = groups.agg(F.bround(F.count("*") * F.lit(fraction)).cast("long").alias("target"))
    placed = _before(_group_order(groups, seed)).crossJoin(F.broadcast(total))  # one row
    part = placed.select("group_id", F.when(F.col("before") < F.col("target"), F.lit("dev")).otherwise(F.lit("train")).alias("part"))
    return groups.join(part, "group_id").select("id", "group_id", "part")


def three_way_split(groups: DataFrame, val: int, screen: int, seed: int = 2026) -> DataFrame:
    """(id, group_id, part): `val` takes whole groups until it holds `val` ids, then `screen`, then `train`."""
    placed = _before(_group_order(groups, seed))
    closes = placed.where(F.col("before") < val).agg(F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0)).alias("closed"))
    named = placed.crossJoin(F.broadcast(closes))  # one row
    part = F.when(F.col("before") < val, F.lit("val")).when(F.col("before") - F.col("closed") < screen, F.lit("screen")).otherwise(F.lit("train"))
    return groups.join(named.select("group_id", part.alias("part")), "group_id").select("id", "group_id", "part")


def hash_sample(df: DataFrame, id_col: str, n: int, salt: str) -> DataFrame:
    """The n rows with the smallest SHA-256 of `salt:id`."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256)
    return df.withColumn("__h", key).orderBy("__h").limit(n).drop("__h")


def stratified_sample(df: DataFrame, id_col: str, stratum_col: str, primary: int, reserve: int, salt: str) -> DataFrame:
    """The first `primary` ids of each stratum by salted hash, then `reserve` more, with their `role` and place."""
    key = F.sha2(F.concat(F.lit(f"{salt}|"), F.col(id_col).cast("string")), 256)
    r = F.row_number().over(Window.partitionBy(stratum_col).orderBy(key, id_col))
    return df.select(id_col, stratum_col).withColumn("place", r).where(F.col("place") <= primary + reserve).withColumn("role", F.when(F.col("place") <= primary, F.lit("primary")).otherwise(F.lit("reserve")))


def blinding(id_col: Column, salt: str) -> Column:
    """`A` or `B`: parity of the first eight hex digits of a salted hash."""
    return F.when(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("long") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))


def key_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has; empty if labels and packets agree."""
    return a.join(b, keys, "left_anti").select(*keys, F.lit("only_first").alias("side")).union(b.join(a, keys, "left_anti").select(*keys, F.lit("only_second").alias("side")))


def sft_encoding(prompt_ids: Column, answer_ids: Column, eos: int, most: int) -> tuple[Column, Column]:
    """Input ids and labels: the prompt is masked by -100; what is beyond `most` goes from the answer's end, the end mark stays."""
    room = F.greatest(F.lit(most) - F.size(prompt_ids) - 1, F.lit(0))
    answer = F.concat(F.slice(answer_ids, 1, room), F.array(F.lit(eos)))
    return F.concat(prompt_ids, answer), F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), answer)


def pad_batch(df: DataFrame, batch_col: str, ids: str, labels: str, pad: int) -> DataFrame:
    """Arrays padded to the longest of their batch, with an attention mask."""
    longest = df.groupBy(batch_col).agg(F.max(F.size(ids)).alias("__m"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), (F.col("__m") - F.size(c)).cast("int")))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), (F.col("__m") - F.size(ids)).cast("int")))
    return df.join(longest, batch_col).withColumn("attention_mask", mask).withColumn(labels, fill(F.col(labels), -100)).withColumn(ids, fill(F.col(ids), pad)).drop("__m")


def corpus_census(df: DataFrame, text_col: str) -> DataFrame:
    """One row: counts, characters, percentiles, newline style, HTML remnants, copies."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(t)
    return df.agg(
        F.count("*").alias("documents"), F.count_if(F.col(text_col).isNull()).alias("missing"), F.count_if(F.trim(t) == "").alias("blank"),
        F.sum(n).alias("total_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.stddev_pop(n), 6).alias("std_chars"),
        F.round(F.expr(f"percentile(length(coalesce({text_col}, '')), 0.5)"), 6).alias("p50"), F.round(F.expr(f"percentile(length(coalesce({text_col}, '')), 0.95)"), 6).alias("p95"),
        F.count_if(F.contains(t, F.lit("\r\n"))).alias("crlf"), F.count_if(t.rlike("<[a-zA-Z/][^>]*>")).alias("html"), F.count_if(F.contains(t, F.lit(" | "))).alias("tables"),
        F.countDistinct(F.col(text_col)).alias("distinct_texts"), (F.count(text_col) - F.countDistinct(F.col(text_col))).alias("exact_duplicates"),
    )


def overlap_and_conflicts(a: DataFrame, b: DataFrame, question: str, answer: str) -> DataFrame:
    """One row: questions that two tables share, exactly and normalised, and questions of the first with more than one answer."""
    shared = a.select(question).intersect(b.select(question)).agg(F.count("*").alias("exact"))
    norm = lambda d: d.select(normalise_question(F.col(question)).alias("q"))
    alike = norm(a).intersect(norm(b)).agg(F.count("*").alias("normalised"))
    torn = a.groupBy(normalise_question(F.col(question)).alias("q")).agg(F.countDistinct(answer).alias("n")).where("n > 1").agg(F.count("*").alias("inconsistent"))
    return shared.crossJoin(alike).crossJoin(torn)  # three rows of one


def slug(text: Column) -> Column:
    """ASCII letters and digits of a Vietnamese title, joined by hyphens."""
    folded = F.lower(text)
    for plain, marked in (("a", "àáảãạăằắẳẵặâầấẩẫậ"), ("e", "èéẻẽẹêềếểễệ"), ("i", "ìíỉĩị"), ("o", "òóỏõọôồốổỗộơờớởỡợ"), ("u", "ùúủũụưừứửữự"), ("y", "ỳýỷỹỵ"), ("d", "đ")):
        folded = F.translate(folded, marked, plain * len(marked))
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", "")


def resolve_identity(candidates: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """candidates(document_id, source, value): strict if header and slug agree, ambiguous if values conflict, provisional with one source, else unresolved.

    documents(document_id): what the candidates are of; those without any are unresolved too.
    """
    g = candidates.groupBy("document_id").agg(F.countDistinct("value").alias("values"), F.max(F.when(F.col("source") == "header", F.col("value"))).alias("header"), F.max(F.when(F.col("source") != "header", F.col("value"))).alias("slug"), F.max("value").alias("value"))
    if documents is not None:
        g = documents.select("document_id").distinct().join(g, "document_id", "left").na.fill(0, ["values"])
    status = F.when(F.col("values") > 1, F.lit("ambiguous")).when(F.col("values") == 0, F.lit("unresolved")).when(F.col("header").isNotNull() & F.col("slug").isNotNull(), F.lit("strict")).otherwise(F.lit("provisional"))
    return g.select("document_id", status.alias("status"), F.when(F.col("values") == 1, F.col("value")).alias("value"))


def boundary_risks(chunks: DataFrame, doc: str, index: str, text: str) -> DataFrame:
    """One row: adjacent chunk pairs and how many end in an open enumeration, without an end mark, or in a bare heading."""
    w = Window.partitionBy(doc).orderBy(index)
    pairs = chunks.withColumn("__next", F.lead(text).over(w)).where("__next is not null").withColumn("__tail", F.right(F.trim(text), F.lit(100)))
    t = F.col("__tail")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(t.rlike(r"[:;,]$")).alias("open_enumeration"), F.count_if(~t.rlike(r"[.!?;:]$")).alias("no_end_mark"), F.count_if(t.rlike(r"(?iu)(?:^|\n)(?:điều|khoản|chương|mục)\s+\S+$")).alias("bare_heading"))
