"""Joins of points with ranges of whole numbers or days, of any number and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.operators.storage import BROADCAST_ROWS, written

#: Longest range is two to this power.
LEVELS = 40


def dyadic_blocks(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """A range (both ends included) as aligned blocks of sizes that are powers of two: structs of ``level`` and ``block``.

    The blocks are disjoint and cover the range; there are at most two of each level, so about two log2(length) in all.
    None for an empty range.
    """

    def step(acc: Column, level: Column) -> Column:
        low, high = acc["low"], acc["high"]
        going = low < high
        # An odd start, or end, stands alone on this level; the rest goes up.
        left = F.when(going & (F.pmod(low, F.lit(2)) == 1), F.array(F.struct(level.alias("level"), low.alias("block"))))
        low = F.when(left.isNotNull(), low + 1).otherwise(low)
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), F.array(F.struct(level.alias("level"), (high - 1).alias("block"))))
        high = F.when(right.isNotNull(), high - 1).otherwise(high)
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(acc["out"], F.coalesce(left, none), F.coalesce(right, none))
        return F.struct(F.shiftright(low, 1).alias("low"), F.shiftright(high, 1).alias("high"), out.alias("out"))

    start = F.struct(first.cast("long").alias("low"), (last.cast("long") + 1).alias("high"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])


def _number(value: Column, kind: str) -> Column:
    return F.unix_date(value) if kind == "date" else value.cast("long")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Each row of ``points`` with every row of ``ranges`` whose ``first`` to ``last`` (included) holds its ``at``.

    Whole numbers or dates; a null end, or an end before its start, holds nothing. Ranges may overlap, and be of any
    lengths: they are cut into aligned blocks, and a point is looked up in its one block of each level that occurs. So the
    join is by equality, a pair is found once, and nothing is compared that does not match. Ranges that were counted and
    are few are sent to every task; otherwise both sides are dealt by block, and adaptive execution splits hot ones.
    Columns of both sides must have names of their own.
    """
    kinds = dict(ranges.dtypes) | dict(points.dtypes)
    sound = ranges.where(F.col(first) <= F.col(last))
    cut = sound.select("*", F.explode(dyadic_blocks(_number(F.col(first), kinds[first]), _number(F.col(last), kinds[last]))).alias("_b"))
    cut = written(cut.select(*ranges.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")), "blocks")
    # At most one number for each level.
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())
    if not used:
        return points.join(ranges.limit(0), F.lit(False))
    looked = points.where(F.col(at).isNotNull()).select("*", F.explode(F.array(*[F.lit(level) for level in used])).alias("_level"))
    looked = looked.withColumn("_block", F.expr(f"shiftright({'unix_date' if kinds[at] == 'date' else 'bigint'}({at}), _level)").cast("long"))
    known = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    return looked.join(known, ["_level", "_block"]).drop("_level", "_block")
