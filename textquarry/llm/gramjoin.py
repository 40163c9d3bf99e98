"""Jaccard join of whole tables of texts by their word shingles (operators/setjoin.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_texts
from textquarry.llm.neardup import WORDS, shingle_set
from textquarry.operators.setjoin import SIGNATURE, CountTree, Sections, linked, signature  # noqa: F401
from textquarry.operators.setjoin import SetJoinParams as GramJoinParams
from textquarry.session import materialize


def signatures(df: DataFrame, p: GramJoinParams, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    def factory():
        sections = Sections(p)
        return lambda texts: signature([shingle_set(t, p.shingle) for t in texts], sections)

    return map_texts(df, factory, SIGNATURE, id_col, text_col, extra, keeps=WORDS)


def join_components(df: DataFrame, params: GramJoinParams = GramJoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: the id, n_shingles, and component_id, the smallest id reachable over links, itself included.

    Texts without words, and null texts, have no shingles and link with nothing. Rows that repeat an
    id are one document, so what either text links with is linked. A null id is its own component.
    Texts with equal sets are one class, met by its smallest id. An empty table gives an empty one.
    """
    p = params
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    sig = materialize(signatures(named, p, "id", "text", ("th",)), "sig")
    out = linked(sig, named, p, lambda text: shingle_set(text, p.shingle))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
