"""Read models: game lists, play logs, scoreboard lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.functions.plays import CONVERSION_DOWNS
from playseq.functions.text import plural, short_matchup
from playseq.operators.sequence import GAME, Ordered

PLAY_LOG_COLUMNS = (
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
)


def status_label(status: Column) -> Column:
    """List label; an unknown status passes through."""
    return F.when(status == "pre", "Scheduled").when(status == "in", "LIVE").when(status == "post", "Final").otherwise(status)


def matchups(games: DataFrame) -> DataFrame:
    """Add ``matchup`` (with the score once a game has begun), ``status_label``, ``tag`` and short labels."""
    status = F.coalesce(F.col("status"), F.lit("pre"))
    home, away = F.coalesce(F.col("home_team"), F.lit("")), F.coalesce(F.col("away_team"), F.lit(""))
    score = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("away_score", "home_score")]
    begun = F.concat(away, F.lit(" "), score[0], F.lit("  "), score[1], F.lit(" "), home)
    return games.withColumns(
        {
            "matchup": F.when(status.isin("in", "post"), begun).otherwise(F.concat(away, F.lit(" @ "), home)),
            "status_label": status_label(status),
            "tag": F.when(status == "in", "live").when(status == "post", "final").otherwise("pre"),
            "list_label": short_matchup(away, home, 16, " @ "),
            "alert_label": short_matchup(away, home, 12, " / "),
        }
    )


def game_count(games: DataFrame, noun: str = "game") -> DataFrame:
    """One row: number of games and its text."""
    counted = games.agg(F.count(F.lit(1)).alias("games"))
    return counted.withColumn("games_text", plural(F.col("games"), noun))


def viewer_row_class(index: Column, down: Column, quarter: Column) -> Column:
    """Row class of the viewer; ``index`` is 0-based."""
    parity = F.when(index % 2 == 1, "odd").otherwise("even")
    return (
        F.when(down == "KO", "ko")
        .when(down.isin(*CONVERSION_DOWNS), "ep")
        .when(quarter == "OT", "ot")
        .when(quarter == "4", "q4")
        .when(quarter == "3", "q3")
        .otherwise(parity)
    )


def monitor_row_class(index: Column, qc_issue: Column) -> Column:
    """Row class of the monitor: flagged, else odd or even."""
    flagged = F.coalesce(qc_issue, F.lit("")) != ""
    return F.when(flagged, "flagged").when(index % 2 == 1, "odd").otherwise("even")


def play_log(entries: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Numbered display rows with both row classes."""
    rows = seq.number(entries, "play_no")
    index = F.col("play_no") - 1
    if "qc_issue" not in rows.columns:
        rows = rows.withColumn("qc_issue", F.lit(""))
    rows = rows.withColumns(
        {
            "row_class": viewer_row_class(index, F.col("down"), F.col("quarter")),
            "monitor_class": monitor_row_class(index, F.col("qc_issue")),
        }
    )
    return rows.select(*seq.keys, "play_no", *PLAY_LOG_COLUMNS, "qc_issue", "row_class", "monitor_class")


def latest_play(entries: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Last entry of each game, as a pre-aggregated maximum."""
    rest = [c for c in entries.columns if c not in seq.keys and c not in seq.order]
    last = entries.groupBy(*seq.keys).agg(F.max_by(F.struct(*seq.order, *rest), F.struct(*seq.order)).alias("_last"))
    return last.select(*seq.keys, "_last.*")


def scoreboard_lines(headers: DataFrame) -> DataFrame:
    """Add ``score_line``: names, final scores and status."""
    status = F.when(F.col("status") == "in", "LIVE").when(F.col("status") == "post", "Final").otherwise("Scheduled")
    away, home = F.col("actual_away").cast("string"), F.col("actual_home").cast("string")
    line = F.concat(
        F.col("away_name"), F.lit("  "), away, F.lit("  —  "), home, F.lit("  "), F.col("home_name"), F.lit("     ["), status, F.lit("]")
    )
    return headers.withColumn("score_line", line)
