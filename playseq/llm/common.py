"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from playseq.operators.storage import shared_dir

#: Shuffle files of a query that has been written can go at its end, instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Every fifth document (by the checksum of its id) is never learned from.
FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents kept out of training: crc32 of the id as text, modulo five, is zero."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def appended(df: DataFrame, keep: Sequence[str], fields: Sequence[T.StructField]) -> T.StructType:
    """The columns ``keep`` of ``df``, then ``fields``; a field replaces a kept column of its name."""
    new = {f.name for f in fields}
    return T.StructType([df.schema[c] for c in dict.fromkeys(keep) if c not in new] + list(fields))


def map_text(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
) -> DataFrame:
    """Append ``fields`` computed from whole texts, batch by batch, in Arrow.

    ``make()`` runs once in each task and returns a function from a list of texts (UTF-8, None for null) to one
    list of values for each field.
    """
    schema = appended(df, keep, fields)
    kept = [f.name for f in schema if f.name not in {x.name for x in fields}]
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(len(kept)).cast(pa.binary()).to_pylist()
            values = work(texts)
            made = [pa.array(v, t) for v, t in zip(values, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *made], names=names)

    return df.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, compressed harder: for large texts that are read again."""
    path = f"{shared_dir(df.sparkSession)}/playseq/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Queries that end within the block leave no shuffle files behind; their results are to be written tables."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Rows that go to a Python worker at a time, at most.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Queries that run within the block exchange texts with Python in batches of at most so many rows."""
    before = spark.conf.get(ARROW_ROWS, None)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, before)


def release_memory() -> None:
    """Give memory back that a Python worker's earlier tasks have freed; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library: it keeps what it has
