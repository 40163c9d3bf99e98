"""BM25: index tables, corpus-aware query planning and batched top-k search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import let, terms
from textquarry.session import materialize

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6  #: in place of an idf of 0 or less
#: Words that limit or negate, always kept by the planner.
MODIFIERS = ("chưa", "chỉ", "không", "ngoại", "phải", "trừ")


@dataclass
class Bm25Index:
    """postings(term, chunk_id, tf, doc_len), df(term, df), stats(n, avgdl)."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def _counted(ts: Column) -> Column:
    """array<struct<doc_len, term, tf>> of a text's terms: sorted, then the length of each run of equal ones. Null without terms."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(s))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.size(s).alias("doc_len"), F.get(s, i).alias("term"), (ends(at, j) - i).cast("long").alias("tf"))))

    return let(F.sort_array(ts), lambda s: F.when(F.size(s) > 0, runs(s)))


#: Parts that the postings of one term are dealt to, so that no task writes all of a frequent term's.
TERM_PARTS = 16


def build_index(chunks: DataFrame, id_col: str, text_col: str) -> Bm25Index:
    """Postings with the chunk's length beside each, so that scoring needs no second join by chunk.

    Texts are split once, and a text's terms are counted within its row, so that no task holds the
    counts of many texts and each posting is shuffled once, to be written; rows of one id are added
    up where they meet. Files are sorted by term, so that a search reads only the row groups of its
    terms, and every search of the index reads the same tables. Chunks without terms have no posting,
    and count in the statistics.
    """
    counted = _counted(terms(F.coalesce(text_col, F.lit(""))))
    tall = chunks.select(F.col(id_col).alias("chunk_id"), F.inline_outer(counted)).where("term is not null").withColumn("part", F.pmod(F.hash("chunk_id"), F.lit(TERM_PARTS)))
    once = tall.repartition("term", "part").groupBy("term", "part", "chunk_id", "doc_len").agg(F.sum("tf").alias("tf"))
    postings = materialize(once.select("chunk_id", "doc_len", "term", "tf").sortWithinPartitions("term"), "postings")
    return _index_of(chunks, postings, postings.agg(F.sum("tf").alias("total")))


def _index_of(chunks: DataFrame, postings: DataFrame, length: DataFrame) -> Bm25Index:
    """Postings with their frequencies and the statistics; length(total) is one row, the number of terms of all chunks."""
    frequencies = materialize(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    per_chunk = chunks.select(F.count("*").alias("n"))
    stats = materialize(per_chunk.crossJoin(F.broadcast(length)).select("n", (F.coalesce("total", F.lit(0)) / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl")), "stats")  # one row each
    return Bm25Index(postings, frequencies, stats)


#: Asked terms beyond which a search builds the whole index.
MOST_ASKED = 200_000


def index_for(queries: DataFrame, text_col: str, chunks: DataFrame, id_col: str, chunk_text_col: str, most: int = MOST_ASKED) -> Bm25Index:
    """The index of all chunks as these queries see it: every posting of their terms, and the statistics of all chunks.

    Searches give the same as over the whole index. All texts are read and split in one pass that
    leaves them where they are: the asked terms are a broadcast, and of a chunk its length and its
    counts of asked terms are shuffled and written. Beyond `most` asked terms the whole index is built.
    """
    asked = materialize(queries.select(F.explode(F.array_distinct(terms(F.coalesce(text_col, F.lit(""))))).alias("term")).distinct(), "asked")
    if asked.count() > most:
        return build_index(chunks, id_col, chunk_text_col)
    split = chunks.select(F.col(id_col).alias("chunk_id"), terms(F.coalesce(chunk_text_col, F.lit(""))).alias("ts")).select("chunk_id", F.size("ts").alias("doc_len"), "ts")
    wanted = asked.union(asked.sparkSession.range(1).select(F.lit("")))  # no text has this term; each chunk gets it once, for its length
    tall = split.select("chunk_id", "doc_len", F.explode(F.concat("ts", F.array(F.lit("")))).alias("term")).join(F.broadcast(wanted), "term", "left_semi")  # at most `most` rows
    counted = materialize(tall.groupBy("chunk_id", "doc_len", "term").agg(F.count("*").alias("tf")), "asked_postings")
    return _index_of(chunks, counted.where("term <> ''"), counted.where("term = ''").agg(F.sum(F.col("doc_len") * F.col("tf")).alias("total")))


def plan_queries(queries: DataFrame, index: Bm25Index, query_col: str, text_col: str, max_terms: int = 8, max_df_ratio: float = 0.25) -> DataFrame:
    """(query_id, term, pos, df): the terms each query searches for, at most `max_terms`.

    Terms that no chunk holds are left out unless that leaves none. Terms with a digit and modifiers
    come first in their order, then the rarest, of those in at most `max_df_ratio` of the chunks if
    there are any; the chosen ones keep the question's order in `pos`.
    """
    asked = queries.select(F.col(query_col).alias("query_id"), F.posexplode(F.array_distinct(terms(F.coalesce(text_col, F.lit("")))))).withColumnsRenamed({"col": "term"})
    known = asked.join(index.frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).crossJoin(F.broadcast(index.stats))  # one row
    per_query = Window.partitionBy("query_id")
    first = F.col("term").rlike(r"\p{N}") | F.col("term").isin(*MODIFIERS)
    rare = ~F.col("first") & (F.col("df") <= F.col("n") * max_df_ratio)
    marked = known.withColumn("any_known", F.max(F.col("df") > 0).over(per_query)).where("df > 0 or not any_known").withColumn("first", first).withColumn("rare", rare)
    marked = marked.withColumn("any_rare", F.max("rare").over(per_query))
    fits = F.col("first") | F.col("rare") | ~F.col("any_rare") | ~F.col("any_known")
    order = [F.when(F.col("any_known"), (~F.col("first")).cast("int")).otherwise(0), F.when(F.col("any_known") & ~F.col("first"), F.col("df")).otherwise(0), F.col("pos")]
    ranked = marked.where(fits).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("r") <= max_terms).select("query_id", "term", "pos", "df")


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def search(planned: DataFrame, index: Bm25Index, top_k: int = 10, match_all: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): all queries in one job; ties by chunk_id.

    The planned terms (a few a query) are written first, so that Spark knows their size: few are
    broadcast and the postings stay where they are, many meet them in an equi-join on the term. Scores
    are summed with map-side combine and the top k cut by a ranked window, which Spark limits before
    the shuffle. `only` (chunk_id) restricts the chunks.
    """
    planned = materialize(planned, "planned")
    postings = index.postings if only is None else index.postings.join(only, "chunk_id", "left_semi")
    hits = planned.join(postings, "term").crossJoin(F.broadcast(index.stats))  # one row
    tf = F.col("tf").cast("double")
    part = idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    scored = hits.select("query_id", "chunk_id", part.alias("s")).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"), F.count("*").alias("matched"))
    if match_all:
        sizes = planned.groupBy("query_id").agg(F.count("*").alias("asked"))
        scored = scored.join(sizes, "query_id").where("matched = asked")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.select("query_id", "chunk_id", "score", rank.alias("rank")).where(F.col("rank") <= top_k)


#: Most frequent terms that matched() looks for before it shuffles anything.
HEAD_TERMS = 10_000


def matched(queries: DataFrame, index: Bm25Index, query_col: str, text_col: str) -> DataFrame:
    """(query_id): the queries that search() has any hit for, by terms alone: no posting is read and nothing scored.

    The planner leaves unknown terms out if a query has a known one, so that a query has a hit just if
    a chunk holds one of its terms. A head of frequent terms is broadcast and answers most queries
    where they are; only what is left sends its terms to the whole vocabulary.
    """
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(text_col).alias("text"))
    tall = lambda q: q.select("query_id", F.explode_outer(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).where("term is not null")
    known = index.frequencies.select("term")
    head = index.frequencies.orderBy(F.desc("df"), "term").limit(HEAD_TERMS).select("term")
    by_head = materialize(tall(asked).join(F.broadcast(head), "term", "left_semi").select("query_id").distinct(), "matched")  # a fixed number of rows
    left = asked.join(by_head, "query_id", "left_anti")
    return by_head.union(tall(left).join(known, "term", "left_semi").select("query_id").distinct())


def warnings(queries: DataFrame, planned: DataFrame, hits: DataFrame, query_col: str, text_col: str) -> DataFrame:
    """(query_id, warnings): no indexable terms, terms limited, no matches."""
    asked = queries.select(F.col(query_col).alias("query_id"), F.size(F.array_distinct(terms(F.coalesce(text_col, F.lit(""))))).alias("n_terms"))
    taken = planned.groupBy("query_id").agg(F.count("*").alias("n_taken"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    both = asked.join(taken, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["n_taken", "n_hits"])
    flags = F.array(
        F.when(F.col("n_terms") == 0, F.lit("query_has_no_indexable_terms")),
        F.when((F.col("n_terms") > 0) & (F.col("n_taken") < F.col("n_terms")), F.lit("bm25_query_terms_limited")),
        F.when((F.col("n_terms") > 0) & (F.col("n_hits") == 0), F.lit("no_bm25_matches")),
    )
    return both.select("query_id", F.array_compact(flags).alias("warnings"))
