"""Classification of plays by their type text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playseq.functions.text import has

# Fixed values.
CONVERSION_DOWNS = ("EP", "2PT")
SPECIAL_DOWNS = ("KO", "EP", "2PT")
TIMEOUT_TYPE_ID = 21
NON_PLAY_TYPES = (
    "end period",
    "end of half",
    "end of game",
    "coin toss",
    "two-minute warning",
    "officials time out",
)
NON_PLAY_PHRASES = ("official timeout", "officials time out")


def is_real_play(play_id: Column, play_type: Column, description: Column) -> Column:
    """False for rows that are not plays: no id, period ends, coin toss, official time-outs."""
    kind = F.lower(F.coalesce(play_type, F.lit("")))
    return (
        (F.coalesce(play_id, F.lit("")) != "")
        & ~kind.isin(*NON_PLAY_TYPES)
        & ~has(description, *NON_PLAY_PHRASES)
    )


def is_kickoff(play_type: Column) -> Column:
    return has(play_type, "kickoff") & ~has(play_type, "return")


def is_timeout(play_type: Column, type_id: Column) -> Column:
    by_name = F.lower(F.coalesce(play_type, F.lit(""))) == "timeout"
    return by_name | F.coalesce(type_id == TIMEOUT_TYPE_ID, F.lit(False))


def is_punt(play_type: Column) -> Column:
    return has(play_type, "punt")


def is_field_goal(play_type: Column) -> Column:
    return has(play_type, "field goal")


def is_extra_point(play_type: Column) -> Column:
    return has(play_type, "extra point", "pat")


def is_two_point(play_type: Column) -> Column:
    return has(play_type, "two-point", "two point", "2pt")


def is_rush(play_type: Column) -> Column:
    return has(play_type, "rush") & ~is_kickoff(play_type)


def is_pass(play_type: Column) -> Column:
    return has(play_type, "pass", "reception")


def is_sack(play_type: Column) -> Column:
    return has(play_type, "sack")


def is_conversion(play_type: Column) -> Column:
    """A conversion attempt reported as a play of its own."""
    return has(play_type, "extra point", "two-point", "two point", "pat")


def quarter_label(period: Column) -> Column:
    return F.when(period <= 4, period.cast("string")).otherwise(F.lit("OT"))
