"""Benchmark decontamination in DataFrame functions only.

A broadcast hash set of normalised test n-grams: item windows of `window` words. Ten words in a row
hold a whole block of five words that starts at a multiple of five, so that texts are first tested
by the hashes of such blocks, a fifth of all windows; texts with a block of the set scan all their
windows by hash, and hits are verified by their words against the table of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import shielded
from textquarry.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of texts whose A-Z are not folded
#: Most hashes in a set that goes with the plan (8 bytes each); larger benchmarks take the join instead.
MOST_HASHES = 60_000


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, BREAKS), lambda w: w != "")


def block_length(window: int) -> int:
    """Longest block such that `window` words in a row hold a whole block that starts at a multiple of its length."""
    return (window + 1) // 2


def _in(hashes: list[int]):
    return lambda h: h.isin(hashes)


def item_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(w, len, item_id): distinct windows of each item; an item of fewer words is one window."""
    words = items.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0 and item_id is not null")
    n = F.size("words")
    size = F.least(n, F.lit(window))
    starts = F.sequence(F.lit(1), n - size + 1)
    return words.select("item_id", size.alias("len"), F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("ws")).select("item_id", "len", "ws").distinct()


def _block_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def find_contamination(df: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of df: the id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (start word, words) of merged hits.

    n_hit counts the document's words inside any occurrence of a window. Null texts have no words.
    items_sha256 is over the ids as strings, sorted and comma-joined (of nothing if none). Without
    items nothing is contaminated. Repeated rows each get the same result. Whole texts are scanned.
    """
    windows = materialize(item_windows(items, window, item_col, item_text), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())
    blocks = {}  # block length -> hashes
    small = windows.count() <= MOST_HASHES
    sources = {}
    for size in lengths:
        b = block_length(size)
        mine = windows.where(F.col("len") == size).select(F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - b), lambda i: _block_hash(F.col("ws"), i, b))).alias("h")).distinct()
        sources[b] = sources[b].union(mine).distinct() if b in sources else mine
    if small:
        for b, rows in sources.items():
            blocks[b] = [r.h for r in rows.collect()]
        small = sum(map(len, blocks.values())) <= MOST_HASHES
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")

    def doc_blocks(b: int) -> Column:
        return F.when(n >= b, F.transform(F.sequence(F.lit(0), F.floor(n / b).cast("int") - 1), lambda i: _block_hash(F.col("words"), i * b, b)))

    if small:
        may = F.lit(False)
        for b, hashes in blocks.items():
            may = may | F.coalesce(F.exists(doc_blocks(b), _in(hashes)), F.lit(False))
        docs = docs.withColumn("may", may)
    else:  # a benchmark beyond the bound: blocks meet their set in a join that Spark sizes
        docs = materialize(docs, "words")
        found = None
        for b, rows in sources.items():
            part = docs.select("id", "th", F.explode(doc_blocks(b)).alias("h")).join(rows, "h", "left_semi").select("id", "th")
            found = part if found is None else found.union(part)
        docs = docs.join(found.distinct().withColumn("may", F.lit(True)), ["id", "th"], "left").withColumn("may", F.coalesce("may", F.lit(False)))
    hashed = windows.select(F.xxhash64("ws").alias("h")).distinct()
    known = [r.h for r in hashed.collect()] if small else None

    def scan(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(i.cast("int").alias("at"), F.slice("words", i, size).alias("ws")))
        hits = F.filter(every, lambda x: F.xxhash64(x["ws"]).isin(known)) if small else every
        return F.when(n >= size, hits).otherwise(F.array().cast("array<struct<at:int,ws:array<string>>>"))

    hits = F.concat(*[scan(size) for size in lengths]) if lengths else F.array().cast("array<struct<at:int,ws:array<string>>>")
    empty = F.array().cast("array<struct<at:int,ws:array<string>>>")
    base = materialize(docs.select("id", "th", n.cast("long").alias("n_words"), F.when(F.col("may"), hits).otherwise(empty).alias("hits")), "hits")
    table = windows.select(F.concat_ws(" ", "ws").alias("w"), F.col("len"), "item_id")
    if small:
        table = F.broadcast(table)  # at most MOST_HASHES windows
    hit = base.where(F.size("hits") > 0).select("id", "th", F.explode("hits").alias("x")).select("id", "th", F.col("x.at").alias("at"), F.concat_ws(" ", "x.ws").alias("w"), F.size("x.ws").alias("len"))
    hit = hit.join(table, ["w", "len"])
    per = hit.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("s"), F.array_sort(F.collect_set("item_id")).alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))  # of hit words
    per = per.select("id", "th", "items", places.alias("places"))
    edge = lambda step: F.filter("places", lambda x, i: F.coalesce(F.get(F.col("places"), i + step) != x + step, F.lit(True)))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("len")))
    per = per.select("id", "th", spans.alias("spans"), F.size("places").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    per = per.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
    out = base.select("id", "th", "n_words").join(per, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,len:int>>)")).alias("spans"), F.col("th").alias("text_hash"),
    )


def remove_spans(text: Column, spans: Column) -> Column:
    """The text with each span (1-based start word, words; sorted, apart) replaced by one space, from its first word to its last.

    The text is cut into its words and the stretches between them, one more than words; what stays
    is a stretch and then word and stretch by turns, from the end of a span to the start of the next.
    """
    words = F.regexp_extract_all(text, F.lit(f"({_inverse()}+)"), F.lit(1))
    gaps = F.split(text, f"{_inverse()}+", -1)

    def cut(x: Column) -> Column:
        n = F.size(x["spans"])

        def kept(k: Column) -> Column:
            before = F.get(x["spans"], k - 1)
            start = F.when(k > 0, before["at"] + before["len"]).otherwise(F.lit(1)).cast("int")  # first word kept
            end = F.when(k < n, F.get(x["spans"], k)["at"]).otherwise(F.size(x["words"]) + 1).cast("int")  # first word of the next span
            stretch = F.zip_with(F.slice(x["words"], start, end - start), F.slice(x["gaps"], start + 1, end - start), lambda w, g: F.concat(w, g))
            return F.concat(F.element_at(x["gaps"], start), F.array_join(stretch, ""))

        return F.array_join(F.transform(F.sequence(F.lit(0), n), kept), " ")

    # the text is cut once, whatever the number of spans: its pieces are the one element of an array
    pieces = F.array(F.struct(words.alias("words"), gaps.alias("gaps"), spans.alias("spans")))
    return F.element_at(F.transform(pieces, cut), 1)


def _inverse() -> str:
    return "[^" + BREAKS_RAW[1:]


def decontaminate(df: DataFrame, items: DataFrame, window: int = 10, most_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without hit spans; documents of which more than `most_share` of the words are hit go.

    Untouched documents stay as they are, in all their columns, whatever the names of these. Null
    texts have no words and stay; repeated rows are treated each; empty tables change nothing.
    """
    found = find_contamination(df, items, window, id_col, text_col).where("contaminated").select(F.col(id_col).alias("id"), F.col("text_hash").alias("th"), (F.col("n_hit") > most_share * F.col("n_words")).alias("go"), "spans").distinct()
    held, at = shielded(df)
    text = F.col(at[text_col])
    joined = held.join(found, F.col(at[id_col]).eqNullSafe(F.col("id")) & (F.xxhash64(text.cast("string")) == F.col("th")), "left").where(~F.coalesce("go", F.lit(False)))
    cleaned = F.when(F.col("spans").isNull(), text).otherwise(remove_spans(text, F.col("spans")))
    return joined.select(*[(cleaned if c == text_col else F.col(place)).alias(c) for c, place in at.items()])
