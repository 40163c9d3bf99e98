"""Session and scratch-storage helpers."""

from __future__ import annotations

import atexit
import shutil
from contextlib import contextmanager
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textquarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Whole texts in an Arrow batch: with Spark's 10,000 a batch, and its buffers outside the heap, are most of a task's texts.
TEXT_ROWS = 1024


def text_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have TEXT_ROWS rows at most, unless their number has been set already. No result depends on it."""
    if (key := "spark.sql.execution.arrow.maxRecordsPerBatch") not in spark.conf.getAll:
        spark.conf.set(key, TEXT_ROWS)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of what is written within go as soon as it is written, and not when the driver's memory is next cleaned."""
    held = spark.conf.get(key := "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and all runs in one JVM (tests) a temporary folder is made and set, and
    removed at the end; on a cluster without the setting this fails, as no folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="textquarry-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = "file://" + path
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[str] = []  # paths of materialised tables, in the order they were written


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    Tables that nothing reads any more go by discard() or sweep(); what results still read goes by clear_scratch().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _MADE.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._textquarry_path = path
    return found


def mark() -> int:
    """A point in the order of materialised tables, for sweep()."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables materialised after a mark(), but those of `keep`: for steps whose result is written."""
    kept = {getattr(df, "_textquarry_path", None) for df in keep}
    for path in _MADE[since:]:
        if path not in kept:
            _delete(spark, path)
    _MADE[since:] = [path for path in _MADE[since:] if path in kept]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later result reads. Other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_textquarry_path", None):
            _delete(df.sparkSession, path)


def exists(df: DataFrame) -> bool:
    """Whether a materialised table is still there."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._textquarry_path)
    return at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all materialised tables of the scratch folder, once the results that read them are written."""
    _delete(spark, f"{scratch_dir(spark)}/textquarry")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
