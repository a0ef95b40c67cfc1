"""Game-clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_SECONDS = 900

# The first key contained in the lowercased play type gives its length in seconds.
# The order matters, so "blocked punt" is reached as "punt".
PLAY_SECONDS = (
    ("rush", 7),
    ("pass reception", 8),
    ("pass incompletion", 5),
    ("passing touchdown", 8),
    ("rushing touchdown", 7),
    ("punt", 10),
    ("field goal good", 5),
    ("field goal missed", 5),
    ("blocked field goal", 5),
    ("blocked punt", 5),
    ("sack", 7),
    ("penalty", 6),
    ("fumble recovery", 7),
    ("interception", 7),
    ("pass interception return", 7),
    ("kickoff", 5),
    ("kickoff return", 5),
    ("timeout", 0),
)
OTHER_PLAY_SECONDS = 6


def clock_seconds(clock: Column) -> Column:
    """``m:ss`` as seconds; anything that is not two integers is 0."""
    parts = F.split(clock, ":")
    minutes, rest = (F.get(parts, i).try_cast("int").cast("bigint") for i in (0, 1))
    return F.coalesce(F.when(F.size(parts) == 2, minutes * 60 + rest), F.lit(0).cast("bigint"))


def clock_text(seconds: Column) -> Column:
    """Seconds as ``m:ss``; negative values read 0:00."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def play_seconds(play_type: Column) -> Column:
    """Usual length of a play of this type."""
    text = F.lower(play_type)
    (key, seconds), *rest = PLAY_SECONDS
    expr = F.when(text.contains(key), F.lit(seconds))
    for key, seconds in rest:
        expr = expr.when(text.contains(key), F.lit(seconds))
    return expr.otherwise(F.lit(OTHER_PLAY_SECONDS))
