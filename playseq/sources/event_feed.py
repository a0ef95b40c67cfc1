"""Play and entry feeds derived from a table of user events.

Each user is a game, each event a play; event type, value and properties decide what happens. The rules
make every branch of the sequence operators occur (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.functions.clock import clock_text
from playseq.functions.field import signed_position
from playseq.functions.plays import quarter_label
from playseq.operators.sequence import Ordered

EVENT_ORDER = Ordered(("game_id",), ("ts", "event_id"))
TEAMS = {
    "home_team_id": "H",
    "away_team_id": "A",
    "home_name": "Hawks",
    "away_name": "Wolves",
    "home_abbrev": "HWK",
    "away_abbrev": "WLV",
}
TIMEOUT_TEXTS = (
    "timeout HWK",
    "timeout WLV",
    "timeout Hawks",
    "timeout Wolves",
    "timeout home side",
    "timeout visitor",
    "timeout",
)


def read_events(events: DataFrame) -> DataFrame:
    """Event rows with ``game_id``, ``k`` (property) and ``v`` (whole value)."""
    return events.select(
        F.col("user_id").alias("game_id"),
        "ts",
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor("value").cast("int").alias("v"),
    )


def _points(kind: Column, k: Column, pn: Column, n: Column) -> Column:
    by_k = F.when(k % 4 == 0, 6).when(k % 4 == 2, 8).otherwise(7)
    buy, error, click = kind == "purchase", kind == "error", kind == "click"
    return (
        F.when(buy & (k == 15), 0)
        .when(buy & (k < 40), by_k)
        .when(buy & (k < 55), 3)
        .when(buy & (k < 70), 7)
        .when(buy, 1)
        .when(error & (k == 99), -3)
        .when(error & (k == 98), 5)
        .when((pn == 1) & (n > 1) & (k < 30), 7)
        .when((pn == 2) & (k < 40), 6)
        .when(error & k.between(90, 95), 6)
        .when(click & (k == 7), -7)
        .when(click & (k == 6), -8)
        .otherwise(0)
    )


def _play_type(kind: Column, k: Column, pn: Column) -> Column:
    def banded(*bands) -> Column:
        expr = None
        for limit, text in bands[:-1]:
            expr = F.when(k < limit, text) if expr is None else expr.when(k < limit, text)
        return expr.otherwise(bands[-1])

    return (
        F.when(pn == 1, "Kickoff")
        .when(
            kind == "purchase",
            banded(
                (40, "Passing Touchdown"), (55, "Field Goal Good"), (70, "Punt Return Touchdown"), "Extra Point Good"
            ),
        )
        .when(kind == "click", banded((60, "Rush"), (80, "Two Point Rush"), "Sack"))
        .when(kind == "view", banded((70, "Pass Reception"), (90, "Pass Incompletion"), "Pass Interception Return"))
        .when(kind == "signup", banded((50, "Punt"), (75, "Timeout"), "Kickoff Return (Offense)"))
        .otherwise(banded((10, "End Period"), (40, "Penalty"), (60, "Fumble Recovery (Own)"), "Rush"))
    )


def _base(events: DataFrame, seq: Ordered) -> DataFrame:
    """Common part of both feeds: order, period, clock and credited points."""
    one = F.lit(1).cast("bigint")
    df = seq.total(seq.number(events, "n"), cnt=("sum", one))
    n, k = F.col("n"), F.col("k")
    # A game is cut into five periods of equal length: the first row of each follows from the count.
    period = (F.floor((n - 1) * 5 / F.col("cnt")) + 1).cast("int")
    df = df.withColumn("period", period)
    first = F.ceil((F.col("period") - 1) * F.col("cnt") / 5)
    after = F.ceil(F.col("period") * F.col("cnt") / 5)
    df = df.withColumns({"pn": n - first, "pc": after - first})
    pn, buy = F.col("pn"), F.col("event_type") == "purchase"
    x = F.when(F.col("game_id") % 3 == 0, pn - pn % 7).otherwise(pn)
    burnt = F.floor(x * 900 / (F.col("pc") + 1))
    late = F.when(buy & k.isin(25, 65), 1).when(buy & k.isin(35, 60), 2).otherwise(0)
    df = df.withColumns(
        {
            "secs": F.greatest(F.lit(0), 900 - burnt + F.when(k == 50, 400).otherwise(0)),
            "is_home": k % 2 == 0,
            "pts": _points(F.col("event_type"), k, pn, n),
            "late": late,
        }
    )
    for side, mine in (("home", F.col("is_home")), ("away", ~F.col("is_home"))):
        df = df.withColumns(
            {f"_{side}{d}": F.when(mine & (F.col("late") == d), F.col("pts")).otherwise(0) for d in (0, 1, 2)}
        )
    df = seq.shift(df, **{f"_{s}{d}": (F.col(f"_{s}{d}"), d, 0) for s in ("home", "away") for d in (1, 2)})
    df = seq.running(
        df, **{f"{s}_score": ("sum", sum((F.col(f"_{s}{d}") for d in (1, 2)), F.col(f"_{s}0"))) for s in ("home", "away")}
    )
    return df.withColumns(
        {
            "home_score": F.col("home_score").cast("int"),
            "away_score": F.col("away_score").cast("int"),
            "clock": clock_text(F.col("secs")),
            "ord": n,
            "yards_to_endzone": F.when(k % F.when(F.col("game_id") % 4 == 0, 20).otherwise(4) != 0, (k * 7 + n) % 101).cast("int"),
            "gain": F.col("v") % 25 - 5,
            **{c: F.lit(v) for c, v in TEAMS.items()},
        }
    )


def play_feed(events: DataFrame, seq: Ordered = EVENT_ORDER) -> DataFrame:
    """Plays as a source would report them."""
    df = _base(events, seq)
    k, n, kind = F.col("k"), F.col("n"), F.col("event_type")
    df = df.withColumn("play_type_text", _play_type(kind, k, F.col("pn")))
    text = F.col("play_type_text")
    touchdown = text.endswith("Touchdown")
    points = F.when(touchdown, 6).when(text == "Field Goal Good", 3).otherwise(0)
    call = F.element_at(F.array(*[F.lit(t) for t in TIMEOUT_TEXTS]), (k % 7 + 1).cast("int"))
    pat = F.struct(F.lit("Extra Point Good").alias("text"), F.lit(1).alias("value"))
    return df.select(
        *seq.columns,
        "ord",
        F.col("event_id").cast("string").alias("play_id"),
        F.col("ord").alias("sequence_number"),
        "period",
        "clock",
        "play_type_text",
        F.when(text == "Timeout", 21).otherwise(5).alias("play_type_id"),
        F.when(text == "Timeout", call).otherwise(text).alias("description"),
        "home_score",
        "away_score",
        (k % 4 + 1).alias("start_down"),
        (k % 12).alias("start_distance"),
        "yards_to_endzone",
        F.col("gain").alias("stat_yardage"),
        (points > 0).alias("scoring_play"),
        points.alias("score_value"),
        F.when(k % 13 == 0, "X").when(F.floor(n / 6) % 2 == 0, "H").otherwise("A").alias("drive_team_id"),
        F.when(k % 9 != 0, (k + n) % 4 + 1).cast("int").alias("end_down"),
        F.when(touchdown & (k % 5 == 0), pat).alias("point_after_attempt"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("wallclock"),
        *TEAMS,
    )


def entry_feed(events: DataFrame, seq: Ordered = EVENT_ORDER) -> DataFrame:
    """Entries as a mapper would produce them, with faults."""
    df = _base(events, seq)
    k, kind = F.col("k"), F.col("event_type")
    moved = F.when((kind == "purchase") & (k % 10 == 0), 2).otherwise(0)
    down = (
        F.when(F.col("pn") == 1, "KO")
        .when(kind == "purchase", F.when(k < 50, "EP").otherwise("2PT"))
        .when(kind == "click", "1")
        .when(kind == "view", "2")
        .when(kind == "signup", "3")
        .otherwise(F.when(k < 20, "KO").otherwise("4"))
    )
    return df.select(
        *seq.columns,
        "ord",
        (F.col("home_score") - moved).alias("home_score"),
        (F.col("away_score") + moved).alias("away_score"),
        "clock",
        quarter_label(F.col("period")).alias("quarter"),
        down.alias("down"),
        (k % 12).alias("distance"),
        "gain",
        signed_position(F.col("yards_to_endzone")).alias("field_position"),
        F.when(F.col("is_home"), F.col("home_name")).otherwise(F.col("away_name")).alias("possession"),
        F.lit("No").alias("run_clock"),
        F.lit("No").alias("home_time_out"),
        F.lit("No").alias("away_time_out"),
        kind.alias("play_text"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("wallclock"),
        "home_name",
        "away_name",
    )
