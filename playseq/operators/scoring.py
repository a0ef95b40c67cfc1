"""Score repair: missing conversions, scoring sides, the score lag, and gaps at period ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playseq.functions.plays import CONVERSION_DOWNS, is_conversion
from playseq.functions.text import score_rises
from playseq.operators.sequence import GAME, Ordered
from playseq.operators.storage import merged

CONVERSION_TYPE = "struct<text:string,value:int>"
SCORE = "struct<home:int,away:int>"
# Rows of a run that are folded before their results are appended.
BLOCK = 512

# Rise of the score on a touchdown, and the conversion it stands for.
CONVERSION_BY_RISE = {
    7: ("Extra Point Good", 1),
    8: ("Two-Point Conversion", 2),
    6: ("Extra Point Attempt - No Good", 0),
}

HOME_RESTORED = "Auto-fixed: EP credited to wrong team (home restored +%d)"
AWAY_RESTORED = "Auto-fixed: EP credited to wrong team (away restored +%d)"
GAP_NOTE = "Manual entry required — scoring play(s) missing from feed"


def _prior_scores(df: DataFrame, seq: Ordered) -> DataFrame:
    return seq.shift(df, _prev_home=(F.col("home_score"), 1, 0), _prev_away=(F.col("away_score"), 1, 0))


def infer_conversions(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add the conversion a bare touchdown must have had, judging by the score.

    Touchdowns are left alone when one of the next two plays is a conversion attempt of its own.
    """
    original = df.columns
    attempt = is_conversion(F.col("play_type_text"))
    df = seq.shift(_prior_scores(df, seq), _next1=(attempt, -1, False), _next2=(attempt, -2, False))
    rise = F.greatest(F.col("home_score") - F.col("_prev_home"), F.col("away_score") - F.col("_prev_away"))
    inferred = F.lit(None).cast(CONVERSION_TYPE)
    for points, (text, value) in CONVERSION_BY_RISE.items():
        found = F.struct(F.lit(text).alias("text"), F.lit(value).alias("value"))
        inferred = F.when(rise == points, found).otherwise(inferred)
    bare = F.col("point_after_attempt").isNull() & (F.col("score_value") == 6)
    missing = bare & ~F.col("_next1") & ~F.col("_next2")
    pat = F.when(missing, inferred).otherwise(F.col("point_after_attempt"))
    return df.withColumn("point_after_attempt", pat).select(*original)


def scoring_side(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``td_scoring_team`` to plays with a conversion: the side whose score rose by 6 or more.

    Feeds may credit the score late, so the next two plays are tried as well; home wins ties.
    """
    home, away = F.col("home_score"), F.col("away_score")
    df = seq.shift(_prior_scores(df, seq), _home1=(home, -1), _away1=(away, -1), _home2=(home, -2), _away2=(away, -2))
    side = F.lit(None).cast("string")
    for suffix in ("_2", "_1", ""):
        h, a = (home, away) if not suffix else (F.col("_home" + suffix[1]), F.col("_away" + suffix[1]))
        side = F.when(h - F.col("_prev_home") >= 6, "home").when(a - F.col("_prev_away") >= 6, "away").otherwise(side)
    side = F.when(F.col("point_after_attempt").isNotNull(), side)
    helpers = ["_prev_home", "_prev_away", "_home1", "_away1", "_home2", "_away2"]
    return df.withColumn("td_scoring_team", side).drop(*helpers)


def scoreboard_lag(df: DataFrame, seq: Ordered = GAME, *, initial_home: int = 0, initial_away: int = 0) -> DataFrame:
    """Show each entry the score before it; the entry's own score stays as ``scored_home/away``."""
    df = df.withColumns({"scored_home": F.col("home_score"), "scored_away": F.col("away_score")})
    return seq.shift(
        df, home_score=(F.col("scored_home"), 1, initial_home), away_score=(F.col("scored_away"), 1, initial_away)
    )


def final_score(games: DataFrame, entries: DataFrame, seq: Ordered = GAME, *, home: str = "home_score", away: str = "away_score") -> DataFrame:
    """One row per game: the unlagged score of its last entry, 0 to 0 without entries."""
    last = entries.groupBy(*seq.keys).agg(F.max(F.struct(*seq.order, home, away)).alias("_last"))
    zero = F.lit(0)
    return (
        games.join(merged(last), list(seq.keys), "left")
        .withColumns(
            {
                "actual_home": F.coalesce(F.col("_last")[home], zero),
                "actual_away": F.coalesce(F.col("_last")[away], zero),
            }
        )
        .drop("_last")
    )


def _home_was_cut(prev: Column, row: Column) -> Column:
    return (row["home"] < prev["home"]) & (row["away"] >= prev["away"])


def _away_was_cut(prev: Column, row: Column) -> Column:
    return (row["away"] < prev["away"]) & (row["home"] >= prev["home"])


def _repaired(prev: Column, row: Column) -> Column:
    """Move points back to the side that lost them; the total of the row stays."""

    def score(home: Column, away: Column) -> Column:
        return F.struct(home.cast("int").alias("home"), away.cast("int").alias("away"))

    points = row["home"] + row["away"]
    return (
        F.when(_home_was_cut(prev, row), score(prev["home"], points - prev["home"]))
        .when(_away_was_cut(prev, row), score(points - prev["away"], prev["away"]))
        .otherwise(row)
    )


def _folded(rows: Column) -> Column:
    """For each row of a run, in order: the repaired score before it (null for the first) and its own.

    Each step of a fold copies its state. Blocks keep that short: the cost grows with the power 1.5 of the run's
    length up to some hundred thousand rows, instead of its square.
    """

    def step(state: Column, nth: Column) -> Column:
        row = F.get(rows, nth)
        before, given = state["last"], F.struct(row["home_score"].cast("int").alias("home"), row["away_score"].cast("int").alias("away"))
        score = F.when(before.isNull(), given).otherwise(_repaired(before, given))
        both = F.struct(before.alias("before"), score.alias("score"))
        return F.struct(score.alias("last"), F.concat(state["steps"], F.array(both)).alias("steps"))

    def block(done: Column, nth: Column) -> Column:
        none = F.array().cast(f"array<struct<before:{SCORE},score:{SCORE}>>")
        start = F.struct(F.try_element_at(done, F.lit(-1))["last"].alias("last"), none.alias("steps"))
        # Rows are read by number: a slice of the run would copy it.
        numbers = F.sequence(nth * BLOCK, F.least(nth * BLOCK + BLOCK, F.size(rows)) - 1)
        return F.concat(done, F.array(F.aggregate(numbers, start, step)))

    blocks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
    empty = F.array().cast(f"array<struct<last:{SCORE},steps:array<struct<before:{SCORE},score:{SCORE}>>>>")
    return F.flatten(F.transform(F.aggregate(blocks, empty, block), lambda done: done["steps"]))


def repair_conversion_scores(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """On conversion rows, give points back to the side whose score fell against the repaired row before.

    The repair of a row depends on the repaired row before it, but only within a run of adjacent
    conversion rows: every other row keeps its score and starts a new run. The rule is folded once over
    each run, which stays in the partition of its game. Adds ``fix_note`` and the number of the run,
    ``conversion_run``.
    """
    original = df.columns
    opens = F.when(F.col("down").isin(*CONVERSION_DOWNS), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    df = seq.running(df, conversion_run=("sum", opens))
    run = [*seq.keys, "conversion_run"]
    row = F.struct(*seq.order, *[c for c in original if c not in {*seq.keys, *seq.order}])
    runs = df.groupBy(*run).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    rows = F.inline(F.arrays_zip("_rows", _folded(F.col("_rows")))).alias("_row", "_step")
    df = runs.select(*run, rows).select(*run, "_row.*", F.col("_step.before").alias("_before"), F.col("_step.score").alias("_fixed"))
    prev, this = F.col("_before"), F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away"))
    note = F.when(_home_was_cut(prev, this), F.format_string(HOME_RESTORED, prev["home"] - this["home"])).when(
        _away_was_cut(prev, this), F.format_string(AWAY_RESTORED, prev["away"] - this["away"])
    )
    df = df.withColumn("fix_note", F.coalesce(note, F.lit("")))
    df = df.withColumns({"home_score": F.col("_fixed")["home"], "away_score": F.col("_fixed")["away"]})
    return df.select(*original, "conversion_run", "fix_note")


def insert_gap_rows(df: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Insert a placeholder before a period-opening kickoff after which the score has risen.

    Such a rise means that scoring plays at the end of the last period are missing. Adds
    ``is_placeholder`` and ``gap_note``; ``ord`` is respaced to make room.
    """
    home, away = F.col("home_score"), F.col("away_score")
    df = seq.shift(
        df, _prev_quarter=(F.col("quarter"), 1), _has_prev=(F.lit(True), 1, False), _next_home=(home, -1), _next_away=(away, -1)
    )
    home_rise, away_rise = F.col("_next_home") - home, F.col("_next_away") - away
    opens = (F.col("down") == "KO") & F.col("_has_prev") & (F.col("quarter") != F.col("_prev_quarter"))
    gap = F.coalesce(opens & ((home_rise > 0) | (away_rise > 0)), F.lit(False))
    rises = score_rises(F.col("home_name"), F.col("away_name"), home_rise, away_rise)
    text = F.concat(F.lit("Score gap at period boundary ("), rises, F.lit(") — enter missing play(s) manually"))
    slots = F.when(gap, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    df = df.withColumn("_text", text).withColumn("_slot", F.explode(slots))
    placeholder = F.col("_slot") == 0
    values = {
        "quarter": F.col("_prev_quarter"),
        "clock": F.lit("0:00"),
        "down": F.lit("?"),
        "distance": F.lit(0),
        "field_position": F.lit(0),
        "gain": F.lit(0),
        "possession": F.lit(""),
        "home_time_out": F.lit("No"),
        "away_time_out": F.lit("No"),
        "run_clock": F.lit("No"),
        "play_text": F.col("_text"),
        "wallclock": F.lit(""),
        "fix_note": F.lit(""),
        "scored_home": F.lit(None).cast("int"),
        "scored_away": F.lit(None).cast("int"),
    }
    changed = {c: F.when(placeholder, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns}
    changed["ord"] = F.col("ord") * 2 + F.col("_slot")
    changed["is_placeholder"] = placeholder
    changed["gap_note"] = F.when(placeholder, F.lit(GAP_NOTE)).otherwise(F.lit(""))
    return df.withColumns(changed).drop("conversion_run", "_prev_quarter", "_has_prev", "_next_home", "_next_away", "_text", "_slot")


def gap_counts(entries: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Placeholders per game."""
    return entries.groupBy(*seq.keys).agg(F.count_if("is_placeholder").alias("gaps"))
