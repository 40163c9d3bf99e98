"""A training-data pipeline over `documents`: toxicity, near duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bytebpe, decontam, neardup, secrets, toxicity
from textquarry.llm.common import shielded
from textquarry.session import discard, mark, materialize, sweep, table, text_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Null and empty texts have no hits and stay; repeated rows are scored each and stay or go
    together; an empty table stays empty; without labels nothing is learned and all stay.
    """
    text_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held, at = shielded(docs)
    scored = toxicity.score(held, model, at["doc_id"], at["text"], extra=tuple(p for c, p in at.items() if c != "doc_id"))
    return scored.where("predicted = 0").select(*[F.col(p).alias(c) for c, p in at.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays.

    Null texts and texts without words link with nothing and stay, as do rows without an id. Rows
    that repeat an id are one document: one of them stays, the first by a hash of all columns. An
    empty table stays empty.
    """
    text_batches(spark)
    found = neardup.near_duplicates(docs).where("doc_id is not null")
    decided = materialize(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).where("not kept or rows > 1"), "decided")
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")
    again = docs.join(decided.where("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("__row.*")
    return docs.join(decided.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go.

    Null and empty texts stay, repeated rows are treated each, an empty table or benchmark changes
    nothing; whole texts are read, whatever their length.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by a mask; every document stays.

    Null texts stay null; repeated rows are masked each; an empty table stays empty.
    """
    text_batches(spark)
    held, at = shielded(docs)
    found = secrets.scan_secrets(held, id_col=at["doc_id"], text_col=at["text"], extra=tuple(p for c, p in at.items() if c not in ("doc_id", "text")), with_text=True)
    return found.select(*[F.col("masked_text" if c == "text" else p).alias(c) for c, p in at.items()])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests; a null text has none, repeated rows are encoded each, other columns are not read."""
    text_batches(spark)
    return bytebpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("secrets", mask_secrets), ("encoding", encode)]

#: SQL can't express the learned and tokenizer stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, at = docs, mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            sweep(spark, at, docs)  # what the stage wrote on its way
            discard(before)
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids"))
