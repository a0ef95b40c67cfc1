"""Materialisation and join helpers that keep hot keys and lost executors harmless."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence as Names

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Rows below which a counted table is small enough to copy to every executor.
BROADCAST_ROWS = 200_000
# The same for keys of games, of which a run holds several tables at once: copies go through the driver.
BROADCAST_KEYS = 20_000
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session, which has no other machines, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="playseq-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a local relation, whose size the optimizer knows."""
    fields = spark.createDataFrame([], schema).schema
    columns = list(zip(*rows)) or [[] for _ in fields]
    arrow = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields)], names=fields.names)
    return spark.createDataFrame(arrow, fields)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows as a columnar table in the shared folder and read them from there.

    This cuts the lineage at storage that outlives executors, computes the rows once, and lets each
    reader scan only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/playseq/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """The right side of a join with about a row per game, joined by shuffle and sort whatever its size.

    Adaptive execution judges by compressed bytes: it would copy a million similar rows, ten times that size unpacked,
    through the driver.
    """
    return df.hint("merge")


REST = "_rest"


def packed(df: DataFrame, keep: Names[str]) -> DataFrame:
    """All columns but ``keep`` in one, which windows and sorts copy as a whole instead of value by value.

    It may be packed again, for steps that need fewer columns.
    """
    rest = [c for c in df.columns if c not in keep]
    return df.select(*[c for c in df.columns if c in keep], F.struct(*rest).alias(REST)) if rest else df


def unpacked(df: DataFrame) -> DataFrame:
    """The columns of ``packed`` again. A generator, as the optimizer would move plain fields below the windows."""
    while REST in df.columns:
        df = df.select(*[c for c in df.columns if c != REST], F.inline(F.array(REST)))
    return df


def _same(left: DataFrame, right: DataFrame, names: Names[str]):
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def _salted(df: DataFrame, small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread the rows of each key over salts, and repeat the small side once per salt."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return rows, small.withColumn("_salt", salts)


def filter_by_keys(df: DataFrame, wanted: DataFrame, keys: Names[str], *, keep: bool = True, hot: bool = True) -> DataFrame:
    """Rows of ``df`` whose keys are (or are not) in ``wanted``, a written table.

    A counted, small ``wanted`` is broadcast. A larger one is repeated once per salt, so that the
    rows of one hot key spread over many tasks; ``hot=False`` says that keys have few rows each, and saves the copies.
    """
    how = "left_semi" if keep else "left_anti"
    wanted = wanted.select(*keys)
    if wanted.count() <= min(BROADCAST_KEYS, BROADCAST_ROWS):
        wanted = F.broadcast(wanted.alias("wanted"))
        return df.join(wanted, _same(df, wanted, keys), how)
    if not hot:
        wanted = merged(wanted.alias("wanted"))
        return df.join(wanted, _same(df, wanted, keys), how)
    rows, wanted = _salted(df, wanted)
    return rows.join(merged(wanted), _same(rows, wanted, [*keys, "_salt"]), how).drop("_salt")


def lookup(df: DataFrame, found: DataFrame, keys: Names[str]) -> DataFrame:
    """Add the other columns of ``found`` (a written table, one row per key) to ``df``; null without a match.

    Copied to all executors if counted and small, else joined with salts, as hot keys are to be expected.
    """
    if found.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(found), list(keys), "left")
    rows, found = _salted(df, found)
    return rows.join(found, [*keys, "_salt"], "left").drop("_salt")
