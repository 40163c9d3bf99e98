"""How far the sources of a language differ in their terms, by joint count histograms.

1. Tasks tally their documents' terms by language and source in bounded tables; sums follow.
2. A kept term becomes one row: its language and its counts in the sources that have it.
3. For every two sources of a language, the terms are tallied by their two counts. Terms that one of
   them or both lack aren't visited: those cells are implied by the histograms of single sources and
   the number of kept terms, and come in as signed multiplicities.
4. The divergence is worked out once for each combination of counts and multiplied.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.joins import hot_join
from textquarry.session import materialize


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 10  #: documents of the language that a kept term is in
    top_terms: int = 10  #: ranks of terms reported for each group
    prior: int = 2  #: added to each count
    scale: int = 1_000_000_000  #: shares are whole numbers of this
    held: int = 300_000  #: entries that a task tallies before it hands them on; bounds memory only


#: Letters A-Z become small, other ASCII characters but letters a space; all bytes beyond ASCII belong to terms.
_FOLD = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_STRETCH = 1 << 20


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = len(text) if at + _STRETCH >= len(text) else text.find(b" ", at + _STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, held: int) -> DataFrame:
    """(lang, source, term, n, docs) of tasks, from (lang, source, text); a key may occur in several rows, which add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, within = defaultdict(Counter), defaultdict(Counter)

        def emit():
            for (lang, source), terms in counts.items():
                docs_of = within[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.string()),
                        pa.array(list(terms.values()), pa.int64()), pa.array([docs_of[t] for t in terms], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            counts.clear(), within.clear()

        new = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                group = lang, source
                tally, before, seen = counts[group], len(counts[group]), set()
                for terms in stretches(memoryview(text.as_buffer()).tobytes()):
                    tally.update(terms)
                    seen.update(terms)
                within[group].update(seen)
                new += len(tally) - before
                if new >= held:
                    yield from emit()
                    new = 0
        yield from emit()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column, p: DivergenceParams) -> Column:
    return F.call_function("div", (n + p.prior) * F.lit(p.scale), total + p.prior * terms) + 1


def divergence(x: Column, y: Column) -> Column:
    """floor of the squared difference by the sum; the same both ways."""
    return F.call_function("div", (x - y) * (x - y), x + y)


def _sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, v, lang_total) of every group."""
    by_group = kept.select("lang", F.explode("at").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    found = groups.join(by_group, ["lang", "source"], "left")
    found = hot_join(materialize(found, "groups"), by_lang, "lang", "left")
    return found.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")])


def joint_histograms(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, m) for any two sources a < b of a language: m of its kept terms occur na times in a and nb times in b.

    kept: (lang, term, at: array of (source, n), by source, n > 0). sizes: (lang, source, v), v the language's
    number of kept terms. Terms that lack a source have 0 there; all m of a pair add up to v.
    """
    first = kept.select("lang", F.posexplode("at").alias("i", "x"), "at").select("lang", "x", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("y"))
    both = first.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("m"))
    cell = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
    na, nb, m, zero = F.col("na"), F.col("nb"), F.col("m"), F.lit(0).cast("long")
    visited = both.select("lang", "a", "b", F.inline(F.array(cell(na, nb, m), cell(na, zero, -m), cell(zero, nb, -m), cell(zero, zero, m))))

    single = kept.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.source").alias("s"), F.col("x.n").alias("n")).agg(F.count("*").alias("h"))
    lists = sizes.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    n, h, s, o = F.col("n"), F.col("h"), F.col("s"), F.col("o")
    beside = hot_join(materialize(single, "single"), lists, "lang").select("lang", "s", "n", "h", F.explode("sources").alias("o")).where(s != o)
    lone = F.when(s < o, cell(n, zero, h)).otherwise(cell(zero, n, h))
    alone = beside.select("lang", F.least(s, o).alias("a"), F.greatest(s, o).alias("b"), F.inline(F.array(lone, cell(zero, zero, -h))))

    empty = hot_join(sizes.select("lang", "source", "v"), lists, "lang").select("lang", F.col("source").alias("a"), "v", F.explode("sources").alias("b")).where("a < b")
    empty = empty.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), F.col("v").alias("m"))
    cells = visited.unionByName(alone).unionByName(empty)
    return cells.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))


def pair_divergence(kept: DataFrame, sizes: DataFrame, p: DivergenceParams) -> DataFrame:
    """(lang, source, item, value) for every source and each other source of its language; 0 in a language without kept terms."""
    cells = joint_histograms(kept, sizes)
    a = sizes.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "v")
    b = sizes.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"))
    placed = cells.join(a, ["lang", "a"]).join(b, ["lang", "b"])
    x, y = share(F.col("na"), F.col("ta"), F.col("v"), p), share(F.col("nb"), F.col("tb"), F.col("v"), p)
    value = F.when(F.col("m") > 0, divergence(x, y) * F.col("m")).otherwise(0)
    found = placed.groupBy("lang", "a", "b").agg(F.sum(value).alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return found.select("lang", "value", F.inline(both)).select("lang", "source", "item", "value")


def term_divergence(kept: DataFrame, sizes: DataFrame, p: DivergenceParams) -> DataFrame:
    """(lang, source, item, value) for kept terms that a source uses, and uses more than its language as a whole."""
    group = F.struct("lang", "source")
    rows = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("of_lang"), F.explode("at").alias("x")).select("item", "of_lang", F.struct("lang", "x.source").alias("group"), F.col("x.n").alias("n"))
    placed = hot_join(rows, sizes.select(group.alias("group"), "total", "v", "lang_total"), "group")
    x, y = share(F.col("n"), F.col("total"), F.col("v"), p), share(F.col("of_lang"), F.col("lang_total"), F.col("v"), p)
    return placed.where(x > y).select("group.lang", "group.source", "item", divergence(x, y).alias("value"))


def audit_sources(df: DataFrame, params: DivergenceParams = DivergenceParams(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, each other source of the language; part `term`, the first `top_terms` terms.

    Null languages, sources and texts count as ''. A row is a document, so repeated rows count again.
    Groups without terms have their rows among pairs, with counts of 0; where no term is kept all
    values are 0; a source alone in its language has no pairs and, as it doesn't differ from the
    language, no terms. Ties go by the item's bytes. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    p = params
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = term_counts(docs, p.held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("at"))
    kept = materialize(terms.where(F.col("docs") >= p.min_docs).select("lang", "term", "n", "at"), "kept_terms")
    sizes = materialize(_sizes(docs.select("lang", "source").distinct(), kept), "sizes")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda found, part: found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_divergence(kept, sizes, p), "pair").unionByName(ranked(term_divergence(kept, sizes, p), "term").where(F.col("rank") <= p.top_terms))
