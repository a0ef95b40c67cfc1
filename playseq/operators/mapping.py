"""From parsed plays to flat entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.functions import plays as P
from playseq.functions.field import signed_position
from playseq.functions.text import has

ENTRY_COLUMNS = (
    "home_score",
    "away_score",
    "clock",
    "quarter",
    "down",
    "distance",
    "gain",
    "field_position",
    "possession",
    "run_clock",
    "home_time_out",
    "away_time_out",
    "play_text",
    "wallclock",
)


def add_play_flags(df: DataFrame) -> DataFrame:
    """Boolean columns for the class of each play."""
    kind = F.col("play_type_text")
    return df.withColumns(
        {
            "is_kickoff": P.is_kickoff(kind),
            "is_timeout": P.is_timeout(kind, F.col("play_type_id")),
            "is_punt": P.is_punt(kind),
            "is_field_goal": P.is_field_goal(kind),
            "is_extra_point": P.is_extra_point(kind),
            "is_two_point": P.is_two_point(kind),
            "is_rush": P.is_rush(kind),
            "is_pass": P.is_pass(kind),
            "is_sack": P.is_sack(kind),
        }
    )


def add_possession(df: DataFrame) -> DataFrame:
    """Team with the ball; on kickoffs the other side. An unknown drive team counts as home."""
    home_drive = F.col("drive_team_id").eqNullSafe(F.col("home_team_id"))
    away_drive = F.col("drive_team_id").eqNullSafe(F.col("away_team_id"))
    away_ball = (F.col("is_kickoff") & home_drive) | (~F.col("is_kickoff") & ~home_drive & away_drive)
    return df.withColumn("possession", F.when(away_ball, F.col("away_name")).otherwise(F.col("home_name")))


def add_situation(df: DataFrame) -> DataFrame:
    """``down``, ``distance``, ``gain`` and ``field_position``, with fixed values for special plays."""
    kickoff, extra, two = F.col("is_kickoff"), F.col("is_extra_point"), F.col("is_two_point")
    conversion = extra | two
    start_down = F.coalesce(F.nullif(F.col("start_down"), F.lit(0)), F.lit(1)).cast("string")
    start_distance = F.coalesce(F.nullif(F.col("start_distance"), F.lit(0)), F.lit(10))
    no_gain = kickoff | conversion | F.col("is_timeout")
    spot = signed_position(F.col("yards_to_endzone"))
    return df.withColumns(
        {
            "down": F.when(kickoff, "KO").when(extra, "EP").when(two, "2PT").otherwise(start_down),
            "distance": F.when(kickoff, 0).when(conversion, 3).otherwise(start_distance),
            "gain": F.when(no_gain, 0).otherwise(F.coalesce(F.col("stat_yardage"), F.lit(0))),
            "field_position": F.when(kickoff, -35).when(conversion, 3).otherwise(spot),
        }
    )


def add_run_clock(df: DataFrame) -> DataFrame:
    """``Yes`` after a rush short of the first down, when the clock keeps running."""
    first_down = F.col("end_down").eqNullSafe(F.lit(1))
    short = F.col("gain") < F.col("distance")
    runs = F.col("is_rush") & ~F.coalesce(F.col("scoring_play"), F.lit(False)) & ~first_down & short
    return df.withColumn("run_clock", F.when(runs, "Yes").otherwise("No"))


def add_timeouts(df: DataFrame) -> DataFrame:
    """Side that called a time-out: by abbreviation, then name, then the words home, away, visitor."""

    def names(column: str):
        needle = F.coalesce(F.col(column), F.lit(""))
        return (needle != "") & F.lower(F.col("description")).contains(F.lower(needle))

    side = (
        F.when(names("home_abbrev"), "home")
        .when(names("away_abbrev"), "away")
        .when(names("home_name"), "home")
        .when(names("away_name"), "away")
        .when(has(F.col("description"), "home"), "home")
        .when(has(F.col("description"), "away", "visitor"), "away")
    )
    side = F.when(F.col("is_timeout"), side)
    return df.withColumns(
        {f"{s}_time_out": F.when(side.eqNullSafe(F.lit(s)), "Yes").otherwise("No") for s in ("home", "away")}
    )


def split_conversions(df: DataFrame) -> DataFrame:
    """Give every conversion attached to a play a row of its own, after the play.

    The touchdown row shows the score without the conversion, the new row the full score. ``ord`` is
    respaced to make room for the new rows.
    """
    pat = F.col("point_after_attempt")
    value = F.coalesce(pat["value"], F.lit(0))
    own_kind = F.col("is_kickoff") | F.col("is_field_goal") | F.col("is_extra_point") | F.col("is_two_point")
    attached = pat.isNotNull() & ~own_kind
    home_drive = F.col("drive_team_id").eqNullSafe(F.col("home_team_id"))
    # A punt that scores was returned, so the side without the drive scored.
    by_home = F.coalesce(F.col("td_scoring_team") == "home", F.when(F.col("is_punt"), ~home_drive).otherwise(home_drive))
    taken = F.when(attached & (value > 0), value).otherwise(F.lit(0))
    slots = F.when(attached, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = df.withColumns({"_by_home": by_home, "_taken": taken}).withColumn("_slot", F.explode(slots))

    extra = F.col("_slot") == 1
    two_points = has(pat["text"], "two", "2pt", "2-point") | (value == 2)
    values = {
        "down": F.when(two_points, "2PT").otherwise("EP"),
        "distance": F.lit(3),
        "gain": F.lit(0),
        "field_position": F.lit(3),
        "run_clock": F.lit("No"),
        "home_time_out": F.lit("No"),
        "away_time_out": F.lit("No"),
        "play_text": F.coalesce(pat["text"], F.lit("")),
    }
    changed = {c: F.when(extra, v).otherwise(F.col(c)) for c, v in values.items()}
    for side, scored in (("home", F.col("_by_home")), ("away", ~F.col("_by_home"))):
        column = F.col(f"{side}_score")
        changed[f"{side}_score"] = F.when(~extra & scored, column - F.col("_taken")).otherwise(column)
    changed["ord"] = F.col("ord") * 2 + F.col("_slot")
    return df.withColumns(changed).drop("_by_home", "_taken", "_slot")


def map_plays(df: DataFrame, *carry: str) -> DataFrame:
    """All mapping steps: one or two entries per play, with the columns in ``carry`` kept."""
    df = add_play_flags(df)
    df = add_timeouts(add_run_clock(add_situation(add_possession(df))))
    df = df.withColumns({"quarter": P.quarter_label(F.col("period")), "play_text": F.col("description")})
    return split_conversions(df).select(*carry, "ord", *ENTRY_COLUMNS)
