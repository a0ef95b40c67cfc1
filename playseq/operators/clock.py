"""Clock repair: stuck runs, rises within a period, and the clock at the snap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.functions.clock import PERIOD_SECONDS, clock_seconds, clock_text, play_seconds
from playseq.operators.sequence import GAME, Ordered



def _period_runs(df: DataFrame, seq: Ordered) -> DataFrame:
    """Number rows (``_n``) and contiguous runs of one period (``_run``, its first row ``_starts``)."""
    df = seq.shift(df, _prev_period=(F.col("period"), 1), _prev_clock=(F.col("clock"), 1), _has_prev=(F.lit(True), 1, False))
    starts = ~F.col("_has_prev") | ~F.col("period").eqNullSafe(F.col("_prev_period"))
    df = df.withColumn("_starts", starts)
    one = F.lit(1).cast("bigint")
    return seq.running(df, _n=("sum", one), _run=("sum", F.when(F.col("_starts"), one).otherwise(one * 0)))


def _add_first_lower(df: DataFrame, seq: Ordered) -> DataFrame:
    """Add ``_found`` to rows at or after a head with ``_search``: that head (negated ``_n``) and the
    first later head of its run with lower ``_secs``.

    Writing clocks in binary, ``x`` is below ``s`` exactly if for one bit set in ``s`` the bit is clear
    in ``x`` and all higher bits agree. So per bit, rows that agree above it form a group, and the
    nearest later row of the group with the bit clear is the candidate of that bit. Heads that search,
    and lower heads behind them, get one extra row per bit for this; the extra rows stay on the
    partition of their key, so nothing is shuffled, and no pairs or arrays of rows are built.
    """
    secs = F.col("_secs")
    df = seq.total(df, _base=("min", secs), _top=("max", secs))
    # The run number grows, so the maximum belongs to the current run once that has a searching head.
    df = seq.running(df, _sought=("max", F.when(F.col("_search"), F.struct("_run", "_secs"))))
    below = F.col("_is_head") & (F.col("_sought._run") == F.col("_run")) & (secs < F.col("_sought._secs"))
    bits = F.sequence(F.lit(0), F.length(F.bin(F.col("_top") - F.col("_base"))) - 1)
    is_set = "(shiftright(_secs - _base, b) & 1) = 1"
    df = df.withColumn("_bits", F.when(F.col("_search") | F.coalesce(below, F.lit(False)), bits)).withColumn(
        "_bit", F.explode(F.expr(f"concat(array(-1), coalesce(filter(_bits, b -> _search OR NOT {is_set}), array()))"))
    )
    is_copy = F.col("_bit") >= 0
    clear = F.expr("_bit >= 0 AND (shiftright(_secs - _base, _bit) & 1) = 0")
    df = df.withColumn("_group", F.when(is_copy, F.expr("shiftright(_secs - _base, _bit + 1)")))
    group = Ordered((*seq.keys, "_run", "_bit", "_group"), ("_n",), seq.sliced)
    df = group.running(df, backwards=True, _near=("min", F.when(clear, F.struct("_n", "_secs")), False))
    found = F.struct((-F.col("_n")).alias("head"), F.col("_near").alias("near"))
    probe = F.col("_search") & is_copy & ~clear & F.col("_near").isNotNull()
    # Copies come before their row; the negated number makes the minimum restart at each searching head.
    # Windows in plain order that follow can use this sort.
    df = df.withColumn("_last", (~is_copy).cast("int"))
    df = seq.by(*seq.order, "_last", "_bit").running(df, _found=("min", F.when(probe, found)))
    return df.where(~is_copy)


def repair_stuck_clocks(
    df: DataFrame, seq: Ordered = GAME, *, default_elapsed: int = 30, min_streak: int = 6
) -> DataFrame:
    """Spread the clock over runs of at least ``min_streak`` plays that show the same time.

    The run is interpolated down to the first lower clock of the same contiguous period; without one,
    each play costs ``default_elapsed`` seconds. Sequences shorter than ``min_streak`` stay as they are.
    """
    original = df.columns
    return _unstick(_period_runs(df, seq), seq, default_elapsed, min_streak).select(*original)


def _unstick(df: DataFrame, seq: Ordered, default_elapsed: int, min_streak: int) -> DataFrame:
    """The repair, given the columns of :func:`_period_runs`."""
    df = df.withColumn("_secs", clock_seconds(F.col("clock")))
    df = df.withColumn("_is_head", F.col("_starts") | ~F.col("_prev_clock").eqNullSafe(F.col("clock")))
    is_head, seen = F.col("_is_head"), F.struct("_n", "_run", "_secs")
    df = seq.running(df, _own=("max", F.when(is_head, seen)))
    df = seq.running(df, backwards=True, _next=("min", F.when(is_head, seen), False), _end=("max", F.col("_n")))

    own, nxt = F.col("_own"), F.col("_next")
    length = F.coalesce(nxt["_n"], F.col("_end") + 1) - own["_n"]
    same_run = F.coalesce(nxt["_run"] == F.col("_run"), F.lit(False))
    next_is_lower = same_run & (nxt["_secs"] < own["_secs"])
    # Only if the clock rises right after a stuck stretch is there anything to search for.
    df = df.withColumns({"_length": length, "_search": is_head & (length >= min_streak) & same_run & ~next_is_lower})
    df = _add_first_lower(df, seq)

    searched = F.when(F.col("_found.head") == -own["_n"], F.col("_found.near._secs"))
    later = F.when(next_is_lower, nxt["_secs"]).otherwise(searched)
    step = F.col("_n") - own["_n"]
    spread = (own["_secs"] - (own["_secs"] - later) / F.col("_length") * step).cast("bigint")
    stuck = (F.col("_length") >= min_streak) & (step > 0)
    fallen = F.coalesce(spread, own["_secs"] - default_elapsed * step)
    return df.withColumn("clock", F.when(stuck, clock_text(fallen)).otherwise(F.col("clock")))


def clamp_clocks(df: DataFrame, seq: Ordered = GAME, *, min_rows: int = 6) -> DataFrame:
    """Keep the clock from rising within a contiguous period; sequences below ``min_rows`` are left alone."""
    original = df.columns
    return _clamp(_period_runs(df, seq), seq, min_rows).select(*original)


def _clamp(df: DataFrame, seq: Ordered, min_rows: int) -> DataFrame:
    """The clamp, given the columns of :func:`_period_runs`."""
    df = df.withColumn("_secs", clock_seconds(F.col("clock")))
    df = seq.total(df, _rows=("max", F.col("_n")))
    # The run number falls as runs pass, so the minimum restarts with each run.
    df = seq.running(df, _low=("min", F.struct((-F.col("_run")).alias("run"), F.col("_secs").alias("secs"))))
    low = F.least(F.col("_low")["secs"], F.lit(PERIOD_SECONDS).cast("bigint"))
    rises = (F.col("_rows") >= min_rows) & (F.col("_secs") > low)
    return df.withColumn("clock", F.when(rises, clock_text(low)).otherwise(F.col("clock")))


def fix_clocks(df: DataFrame, seq: Ordered = GAME, *, default_elapsed: int = 30, min_streak: int = 6) -> DataFrame:
    """Stuck-clock repair followed by the clamp."""
    original = df.columns
    df = _unstick(_period_runs(df, seq), seq, default_elapsed, min_streak)
    return _clamp(df.select(*original, "_n", "_run"), seq, min_streak).select(*original)


def snap_clocks(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Clock at the snap: end of play plus its usual length, at most the previous play's clock."""
    original = df.columns
    df = df.withColumn("_secs", clock_seconds(F.col("clock")))
    df = seq.shift(df, _prev_secs=(F.col("_secs"), 1), _prev_period=(F.col("period"), 1))
    full = F.lit(PERIOD_SECONDS).cast("bigint")
    ceiling = F.when(F.col("_prev_period").eqNullSafe(F.col("period")), F.col("_prev_secs")).otherwise(full)
    snap = F.least(F.col("_secs") + play_seconds(F.col("play_type_text")), F.coalesce(ceiling, full), full)
    return df.withColumn("clock", clock_text(snap)).select(*original)
