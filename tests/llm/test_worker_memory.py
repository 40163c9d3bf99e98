import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from textquarry.llm import bytebpe, neardup, secrets

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _workers(df):
    def held(batches):
        import os

        from textquarry.llm import common

        for _ in batches:
            kept = [*getattr(common, "_KEPT", {}).values()]
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "runs": [sum(len(o.runs) for o in kept if hasattr(o, "runs"))], "words": [sum(len(o) for o in kept if isinstance(o, dict))]})

    return {r.pid: (r.runs, r.words) for r in df.select("doc_id").mapInArrow(held, "pid long, runs long, words long").collect()}


def test_a_worker_holds_the_tables_of_one_operator(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of some more words than five word"), F.col("id")).alias("text")).coalesce(1)
    write = lambda out: out.write.format("noop").mode("overwrite").save()
    write(bytebpe.encode_texts(df, VOCABULARY, public_tokenizers.PATTERN))
    assert max(r for r, _ in _workers(df).values()) > 4000  # a later task finds what a task before has encoded
    for _ in range(4):
        write(neardup.signatures(df, neardup.NearDupParams(), "doc_id", "text"))
        assert any(w for _, w in _workers(df).values())
        write(bytebpe.encode_texts(df, VOCABULARY, public_tokenizers.PATTERN))
        assert all(not (r and w) for r, w in _workers(df).values())
    wide = df.repartition(32)
    write(secrets.scan_secrets(wide))  # keeps none
    seen = _workers(wide)
    assert seen and not any(r or w for r, w in seen.values())


def test_whole_runs_are_kept_once():
    ranks, rng = bytebpe.read_ranks(VOCABULARY), random.Random(4)
    bpe = bytebpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = sorted({"".join(rng.choice("abcdefghé") for _ in range(9)) for _ in range(3000)})
    for at in range(0, 3000, 100):
        some = words[at : at + 100]
        for t in (" ".join(["x", *some]), " ".join(["x", *(w + rng.choice([",", ".", "'s", ""]) for w in some)]), " ".join(some)):
            assert bpe.encode(t) == lib.encode_ordinary(t)
    fresh = bytebpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    fresh.encode(" ".join(["x", *words]))
    assert len(fresh.runs) == len(words) and len(fresh.cache) == 1


def test_batches_of_texts(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        spark.conf.set(key, 3000)
        corpus_pipeline.encode(spark, df, "")
        assert spark.conf.get(key) == "3000"  # as the user has set it
        spark.conf.unset(key)
        assert corpus_pipeline.encode(spark, df, "").count() == 5000
        assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) <= 1024
    finally:
        spark.conf.unset(key)


def test_space_runs_as_the_pattern():
    bpe, rng = bytebpe.ByteBPE(bytebpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN), random.Random(6)
    for _ in range(30_000):
        t = "".join(rng.choice(["a", "a", "é", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]) for _ in range(rng.randint(0, 6)))
        assert bpe._has_space_runs(t) == bool(bpe.space_runs(t)), repr(t)
