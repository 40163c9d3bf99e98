"""Shared plumbing of the operators: Arrow maps over texts and the folds of the contracts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts handed to a text function at once; bounds the memory of a worker, not what is processed.
SLICE_ROWS = 512
_KEPT: dict[object, object] = {}


def trim(table: dict, limit: int) -> None:
    """Empty the younger half of a full table; the older half holds the frequent keys, which come early."""
    if len(table) > limit:
        for k in [*table][limit // 2 :]:
            del table[k]


def kept(key: object, make: Callable):
    """What make() gives, held by the worker for its later tasks; what it held under another key goes, so that it holds the tables of one operator at a time.

    Functions that are sent to workers ask for their tables here: a module's table that they name
    themselves is sent with them, as a copy for each task.
    """
    keep_only(key)
    return _KEPT[key] if key in _KEPT else _KEPT.setdefault(key, make())


def keep_only(key: object) -> None:
    if key not in _KEPT:
        _KEPT.clear()


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by their places, so that none can clash with what an operator adds; and the new name of each."""
    places = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*places.values()), places


def map_texts(df: DataFrame, factory: Callable, fields: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), keeps: object = None) -> DataFrame:
    """id and `extra` columns of every row, then `fields` (DDL).

    `factory()` runs once in each task and returns f(texts) -> list of columns (lists or Arrow arrays), one value a
    row. Only the named columns leave the JVM, so other columns and clashing names don't matter.
    Null ids and repeated rows stay as they are: one row out for each row in. keeps: the key of the
    kept() tables that f asks for; a task without, or with another, frees what its worker holds.
    """
    passed = [id_col, *extra]
    source = df.select(*passed, F.col(text_col).cast("string").alias("__text"))
    added = T._parse_datatype_string(fields)
    out = T.StructType([*source.select(*passed).schema.fields, *added.fields])
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        keep_only(keeps)
        f = None
        for batch in batches:
            f = f or factory()
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                cols = f(part.column(len(passed)).to_pylist())
                arrays = [part.column(i) for i in range(len(passed))] + [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.name for x in out.fields])

    return source.mapInArrow(run, out)
