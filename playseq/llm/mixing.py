"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a function of training time t in [0, 1], piecewise linear between knots. Its integral says which
share of the source's words is used up to t; inverting that integral at a document's place in the cumulative word
demand of its source gives the document's position in training. Documents are then range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playseq.operators.storage import written

#: Base weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Relative weight over training time, as (time, weight) knots, repeated in the order of the sources: even, falling, rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
WORDS = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a slice: 4096 slices of each source.
SLICE = 3


def time_at(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time at which ``share`` of the integral of a weight schedule has been spent."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    goal = share * F.lit(float(sum(area)))
    out, done = None, [sum(area[:i]) for i in range(len(area))]
    for (t0, w0), (t1, w1), before, own in reversed(list(zip(knots, knots[1:], done, area))):
        rest, slope = goal - F.lit(before), (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, for x = t - t0
        x = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        t = F.lit(t0) + x
        out = t if out is None else F.when(goal < F.lit(before + own), t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source. ``sizes``: one row per source, with ``source`` and ``source_size``.

    Sources in code point order (null last) get ``weights``, repeating, of ``share`` times all words. A target stops at
    ``most`` times its source's size, and the excess goes to the others by weight until no target is above: all targets
    are min(cap, level x weight) for one level, which is raised until the words fit. Only sums reach the driver. The
    ranking sorts one row per source in one task.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    sources = written(sizes.select("source", "source_size", nth.alias("nth"), weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "sources")
    level, capped = -1.0, -1
    total = sources.agg(F.sum("source_size")).first()[0]
    words = share * (total or 0)
    while True:
        over = F.lit(level >= 0) & (F.col("cap") < F.lit(level) * F.col("weight"))
        n, held, rest = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (words - held) / rest, n
    level = max(level, 0.0)
    target = F.when(F.col("cap") < F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "nth", target.alias("target"))


def mix(documents: DataFrame, *, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words each document gives to the mix, and its place in training.

    Returns doc_id, source, size, source_size, target, taken, position (in words of the whole mix; null if nothing is
    taken), second_position (of the repeated pass, else null). A source is walked in the order of md5(doc_id), once
    whole and, if its target exceeds its size, once more in part; the document at the end of the target gives a part of
    its words. So a source's taken words equal its target, rounded, and nothing exceeds twice its size (``most`` <= 2).

    The walk needs running sums within a source. They are taken within 4096 slices of the order key, and a table of the
    slices' sums carries them across, so a source with a third of all rows spreads over thousands of groups. Rows with one
    id and size are walked as one row for each partition they were read in, and dealt out again before they are repeated.

    Null texts, and texts without words, have size 0 and take nothing. A null source is a source of its own, last in
    order; a null doc_id comes first in its source. Repeated rows count each. An empty table gives an empty result.
    Other columns are not read.
    """
    if not 0 < most <= 2:
        raise ValueError("a document can be passed twice at most")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    sized = written(documents.select("doc_id", "source", key.alias("_key"), size.alias("size"), order.alias("_order"), F.spark_partition_id().alias("_part")), "sizes")
    alike = sized.groupBy("_key", "_order", "doc_id", "size", "_part").agg(F.first("source").alias("source"), F.count("*").alias("_copies"))
    alike = written(alike.withColumn("_slice", F.substring("_order", 1, SLICE)), "alike")

    slices = written(alike.groupBy("_key", "_slice").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("_copies")).alias("_sum")), "slices")
    targets = source_targets(slices.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")).drop("_key"), weights, share, most)
    targets = targets.withColumn("_key", key).drop("source")
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = slices.select("_key", "_slice", before.alias("_before")).join(targets, "_key")
    words = float(targets.agg(F.sum("source_size")).first()[0] or 0) * share

    inner = Window.partitionBy("_key", "_slice").orderBy("_order", "doc_id", "size", "_part").rowsBetween(Window.unboundedPreceding, -1)
    walked = alike.withColumn("_inner", F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(inner), F.lit(0))).join(offsets, ["_key", "_slice"])
    # Copies come from one partition of the input each; they are dealt by it before they become rows again.
    dealt = walked.repartition("_key", "_order", "doc_id", "size", "_part")
    walked = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
    start, goal = F.col("_before") + F.col("_inner") + F.col("_copy") * F.col("size"), F.round("target").cast("long")
    taken = [F.greatest(F.least(goal - at, F.col("size")), F.lit(0)) for at in (start, start + F.col("source_size"))]

    def position(at: Column) -> Column:
        part = at.cast("double") / goal.cast("double")
        time = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            time = F.when(F.col("nth") % len(schedules) == i, time_at(part, knots)).otherwise(time)
        return F.floor(time * F.lit(words)).cast("long")

    return walked.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (taken[0] + taken[1]).cast("long").alias("taken"),
        F.when(taken[0] > 0, position(start)).alias("position"),
        F.when(taken[1] > 0, position(start + F.col("source_size"))).alias("second_position"),
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` range-sorted by position; rows that give nothing come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
