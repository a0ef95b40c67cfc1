"""Quality flags on entries (wide form): one text per entry, empty when it is clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.functions.plays import CONVERSION_DOWNS, SPECIAL_DOWNS
from playseq.operators.sequence import GAME, Ordered

# Rises of a score that plays can produce, and drops that only mirror a bundled
# touchdown and conversion.
VALID_RISES = (0, 1, 2, 3, 6, 7, 8)
BUNDLED_DROPS = (-7, -8)
STUCK_ROWS = 4
MISSING_CONVERSION = "Missing EP after TD"


def score_changes(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``home_delta`` and ``away_delta`` against the row before (null on the first row), once."""
    if {"home_delta", "away_delta"} <= set(df.columns):
        return df
    df = seq.shift(df, _prev_home=(F.col("home_score"), 1), _prev_away=(F.col("away_score"), 1))
    return df.withColumns(
        {"home_delta": F.col("home_score") - F.col("_prev_home"), "away_delta": F.col("away_score") - F.col("_prev_away")}
    ).drop("_prev_home", "_prev_away")


def _score_note(delta: Column) -> Column:
    return F.when(
        (delta < 0) & ~delta.isin(*BUNDLED_DROPS), F.concat(F.lit("Score dropped "), delta.cast("string"))
    ).when((delta > 0) & ~delta.isin(*VALID_RISES), F.concat(F.lit("Score jumped +"), delta.cast("string")))


def flag_score_changes(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``home_score_flag`` and ``away_score_flag``: drops and impossible rises."""
    original = df.columns
    flags = {f"{side}_score_flag": _score_note(F.col(f"{side}_delta")) for side in ("home", "away")}
    return score_changes(df, seq).withColumns(flags).select(*original, *flags)


def stuck_rows(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``stuck_row``: position of the row in its stretch of equal clock and quarter.

    Kickoffs and conversions always start a new stretch.
    """
    original = df.columns
    df = seq.shift(df, _clock=(F.col("clock"), 1), _quarter=(F.col("quarter"), 1))
    same = (F.col("clock") == F.col("_clock")) & (F.col("quarter") == F.col("_quarter"))
    goes_on = F.coalesce(same & ~F.col("down").isin(*SPECIAL_DOWNS), F.lit(False))
    df = seq.number(df, "_n").withColumn("_goes_on", goes_on)
    df = seq.running(df, _start=("max", F.when(~F.col("_goes_on"), F.col("_n"))))
    return df.withColumn("stuck_row", F.col("_n") - F.col("_start") + 1).select(*original, "stuck_row")


def flag_stuck_clock(df: DataFrame, seq: Ordered = GAME, *, threshold: int = STUCK_ROWS) -> DataFrame:
    """Add ``stuck_flag`` on the row with which a stretch reaches ``threshold``."""
    note = F.when(F.col("stuck_row") == threshold, F.lit(f"Clock stuck ({threshold}+ plays)"))
    return stuck_rows(df, seq).withColumn("stuck_flag", note).drop("stuck_row")


def missing_conversions(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``bare_touchdown``: a side rose by 6 and neither this row nor the next is a conversion.

    ``after_opening_kickoff`` tells rows right after a kickoff that opened a period. Needs
    :func:`score_changes`.
    """
    df = seq.shift(
        df,
        _next_down=(F.col("down"), -1, ""),
        _prev_down=(F.col("down"), 1, ""),
        _quarter1=(F.col("quarter"), 1),
        _quarter2=(F.col("quarter"), 2),
    )
    six = (F.col("home_delta") == 6) | (F.col("away_delta") == 6)
    attempt = F.col("down").isin(*CONVERSION_DOWNS) | F.col("_next_down").isin(*CONVERSION_DOWNS)
    opening = (F.col("_prev_down") == "KO") & (F.col("_quarter1") != F.col("_quarter2"))
    return df.withColumns(
        {
            "bare_touchdown": F.coalesce(six, F.lit(False)) & ~F.coalesce(attempt, F.lit(False)),
            "after_opening_kickoff": F.coalesce(opening, F.lit(False)),
        }
    ).drop("_next_down", "_prev_down", "_quarter1", "_quarter2")


def flag_missing_conversions(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``conversion_flag`` (the rise is on the row) and ``earlier_conversion_flag``.

    A rise that shows up on a kickoff belongs to the row before, which gets the second flag; one right
    after a period-opening kickoff is not reported.
    """
    original = df.columns
    df = missing_conversions(score_changes(df, seq), seq)
    kickoff = F.col("down") == "KO"
    own = F.col("bare_touchdown") & ~kickoff & ~F.col("after_opening_kickoff")
    df = seq.shift(df, _from_kickoff=(F.col("bare_touchdown") & kickoff, -1, False))
    note = F.lit(MISSING_CONVERSION)
    df = df.withColumns(
        {"conversion_flag": F.when(own, note), "earlier_conversion_flag": F.when(F.col("_from_kickoff"), note)}
    )
    return df.select(*original, "conversion_flag", "earlier_conversion_flag")


FLAG_COLUMNS = ("home_score_flag", "away_score_flag", "stuck_flag", "conversion_flag", "earlier_conversion_flag")


def flag_entries(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``qc_issue``: all flags of an entry in check order, joined by " · "; empty when clean."""
    original = df.columns
    df = flag_score_changes(score_changes(df, seq), seq)
    df = flag_missing_conversions(flag_stuck_clock(df, seq), seq)
    return df.select(*original, F.concat_ws(" · ", *FLAG_COLUMNS).alias("qc_issue"))
