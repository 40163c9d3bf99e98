"""Incremental jobs on Structured Streaming: ingestion to chunks, and resumable batch answering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.chunking import ChunkParams, chunk_documents
from textquarry.operators.gates import prefix_problems, refuse


def ingest_chunks(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, id_col: str, text_col: str, params: ChunkParams = ChunkParams()):
    """Chunk all files of a folder that no run has taken yet, each document id once, and end.

    A batch is written as a whole to a folder of its number (column `batch`), over what a stopped
    try of it left, and takes only documents that no other batch has chunks of. What is known lies in
    the table alone, so that the stream holds no state, however many documents have passed. A
    document without chunks is looked at again when it comes again.
    """

    def write(docs: DataFrame, number: int) -> None:
        new = docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        if (done := ingested(spark, out)) is not None:
            new = new.join(done.where(F.col("batch") != number).select(F.col("document_id").alias(id_col)).distinct(), id_col, "left_anti")
        chunk_documents(new, id_col, text_col, None, params).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> DataFrame | None:
    """The chunks that ingest_chunks has written, with the number of their batch; None before the first."""
    try:
        return spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def resume_answers(questions: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame], id_col: str = "question_id", pos_col: str | None = None) -> int:
    """Answer what `path` lacks and append it; gives how many were left.

    With `pos_col`, the place of a question, records that aren't the ordered beginning of the
    questions are refused: they belong to another batch.
    """
    spark = questions.sparkSession
    try:
        done = spark.read.parquet(path)
        if pos_col:
            refuse(prefix_problems(questions, done, id_col, pos_col), "records aren't the beginning of these questions")
        left = questions.join(done.select(id_col), id_col, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = questions
    n = left.count()
    if n:
        answer(left).write.mode("append").parquet(path)
    return n


def event_windows(events: DataFrame, watermark: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; late events beyond the watermark are dropped when streaming."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
