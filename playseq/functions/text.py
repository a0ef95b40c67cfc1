"""Text expressions for labels, alerts and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has(text: Column, *needles: str) -> Column:
    """True if the text contains any needle, ignoring case; null text contains nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for needle in needles:
        hit = hit | low.contains(needle)
    return hit


def plural(count: Column, noun: str) -> Column:
    """``1 game``, ``0 games``."""
    return F.concat(count.cast("string"), F.lit(" " + noun), F.when(count != 1, F.lit("s")).otherwise(F.lit("")))


def plural_or_none(count: Column, noun: str) -> Column:
    """Like :func:`plural`, but zero reads ``none``."""
    return F.when(count == 0, F.lit("none")).otherwise(plural(count, noun))


def short_matchup(away: Column, home: Column, width: int, separator: str) -> Column:
    return F.concat(F.substring(away, 1, width), F.lit(separator), F.substring(home, 1, width))


def signed(number: Column) -> Column:
    return F.format_string("%+d", number)


def grouped_int(number: Column) -> Column:
    """With thousands separators."""
    return F.format_number(number, 0)


def one_decimal(number: Column) -> Column:
    return F.format_string("%.1f", number)


def day_range(start: Column, end: Column) -> Column:
    """``yyyyMMdd-yyyyMMdd``."""
    return F.concat_ws("-", F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd"))


def wall_time(ts: Column, twelve_hour: bool = False) -> Column:
    return F.date_format(ts, "hh:mm:ss a" if twelve_hour else "HH:mm:ss")


def alert_key(game_id: Column, kind: Column, detail: Column) -> Column:
    return F.concat_ws(":", game_id.cast("string"), kind, detail)


def score_rises(home: Column, away: Column, home_delta: Column, away_delta: Column) -> Column:
    """``Hawks +7, Wolves +3``: rising sides only."""
    return F.concat_ws(
        ", ",
        F.when(home_delta > 0, F.concat(home, F.lit(" +"), home_delta.cast("string"))),
        F.when(away_delta > 0, F.concat(away, F.lit(" +"), away_delta.cast("string"))),
    )
