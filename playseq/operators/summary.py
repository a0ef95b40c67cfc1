"""Quality summary of a set of games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.functions.text import grouped_int, one_decimal, plural_or_none

GAMES_RED = 0.3
PLAYS_GREEN, PLAYS_ORANGE = 2, 5


def play_counts(entries: DataFrame, *keys: str) -> DataFrame:
    """Plays per game."""
    return entries.groupBy(*(keys or ("game_id",))).agg(F.count(F.lit(1)).alias("play_count"))


def summarise(games: DataFrame, counts: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: games and plays with unresolved issues, by kind, with shares, bands and texts.

    Distinct counts are nested plain counts: issues collapse to plays and plays to games before the
    single final row, so no step holds a set.
    """
    kind, open_issue = F.col("type"), F.col("severity").isin("ERROR", "WARNING")

    def any_of(condition):
        return F.max(F.when(condition, F.lit(1)).otherwise(F.lit(0)))

    per_play = issues.groupBy("game_id", "play_index").agg(
        F.count(F.lit(1)).alias("issues"),
        any_of(open_issue).alias("open"),
        any_of(open_issue & (F.col("play_index") >= 0)).alias("flagged"),
        any_of(open_issue & kind.isin("score_regression", "invalid_score_jump")).alias("score"),
        any_of(open_issue & (kind == "stuck_clock")).alias("clock"),
        any_of(open_issue & (kind == "missing_ep")).alias("ep"),
    )
    per_game = per_play.groupBy("game_id").agg(
        F.sum("issues").alias("issues"),
        F.sum("flagged").alias("flagged"),
        *[F.max(c).alias(c) for c in ("open", "score", "clock", "ep")],
    )
    measures = [
        games.select(F.lit(1).alias("total_games")),
        counts.select(F.col("play_count").alias("total_plays")),
        per_game.select(
            F.col("issues").alias("issues_found"),
            F.col("open").alias("games_with_issues"),
            F.col("score").alias("games_with_score"),
            F.col("clock").alias("games_with_clock"),
            F.col("ep").alias("games_with_ep"),
            F.col("flagged").alias("flagged_plays"),
        ),
    ]
    # Every measure is a sum, so the three inputs are stacked and added up together.
    names = [c for part in measures for c in part.columns]
    stacked = None
    for part in measures:
        part = part.select(*[(F.col(c) if c in part.columns else F.lit(0)).cast("bigint").alias(c) for c in names])
        stacked = part if stacked is None else stacked.unionByName(part)
    return add_bands(stacked.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in names]))


def add_bands(row: DataFrame) -> DataFrame:
    """Percent flagged, colour bands and texts of a summary row."""
    n, total, plays = F.col("games_with_issues"), F.col("total_games"), F.col("total_plays")
    pct = F.when(plays > 0, F.col("flagged_plays") / plays * 100).otherwise(F.lit(0.0))
    row = row.withColumn("pct_flagged", pct)
    pct = F.col("pct_flagged")
    many = n / F.greatest(total, F.lit(1)) > GAMES_RED
    return row.withColumns(
        {
            "games_band": F.when(n == 0, "green").when(many, "red").otherwise("orange"),
            "plays_band": F.when(pct < PLAYS_GREEN, "green").when(pct < PLAYS_ORANGE, "orange").otherwise("red"),
            "games_text": F.when(n == 0, F.format_string("✓  All %d games are clean", total)).otherwise(
                F.format_string("%d of %d games have issues", n, total)
            ),
            "score_text": plural_or_none(F.col("games_with_score"), "game"),
            "clock_text": plural_or_none(F.col("games_with_clock"), "game"),
            "ep_text": plural_or_none(F.col("games_with_ep"), "game"),
            "plays_text": F.concat(grouped_int(plays), F.lit(" plays scanned · "), one_decimal(pct), F.lit("% flagged")),
            "done_text": F.format_string("Done — %d games, %d issue(s) found", total, F.col("issues_found")),
        }
    )
