"""Alerts: keys, deduplication, and the game lists derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.functions.text import alert_key
from playseq.operators.storage import merged

# Order of issues within a batch, for "first one wins".
ISSUE_ORDER = ("play_index", "check_no")


def with_alert_keys(issues: DataFrame) -> DataFrame:
    """Add ``alert_key``: game, type and message."""
    return issues.withColumn("alert_key", alert_key(F.col("game_id"), F.col("type"), F.col("message")))


def first_per_key(df: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The first row per key. A pre-aggregated minimum, so copies of one key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def new_alerts(issues: DataFrame, seen: DataFrame | None = None, order: tuple[str, ...] = ISSUE_ORDER) -> DataFrame:
    """One alert per key that is not in ``seen`` (any table with ``alert_key``) yet."""
    fresh = first_per_key(with_alert_keys(issues), ["alert_key"], order)
    if seen is None:
        return fresh
    return fresh.join(seen.select("alert_key"), "alert_key", "left_anti").select(*fresh.columns)


def clean_game_alerts(games: DataFrame, issues: DataFrame, counts: DataFrame) -> DataFrame:
    """One OK alert per game without issues; these are never deduplicated."""
    clean = games.join(merged(issues.select("game_id").distinct()), "game_id", "left_anti")
    plays = F.coalesce(F.col("play_count"), F.lit(0))
    return clean.join(merged(counts.select("game_id", "play_count")), "game_id", "left").select(
        "game_id",
        F.lit("OK").alias("severity"),
        F.lit("ok").alias("type"),
        F.concat(F.lit("No issues found — "), plays.cast("string"), F.lit(" plays checked")).alias("message"),
    )


def failure_alerts(failed: DataFrame, reason: Column) -> DataFrame:
    """One ERROR alert per game that could not be read; these are never deduplicated."""
    return failed.select(
        "game_id",
        F.lit("ERROR").alias("severity"),
        F.lit("fetch_failed").alias("type"),
        F.concat(F.lit("Failed to fetch plays: "), reason).alias("message"),
    )


def newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("alert_time").desc(), F.col("alert_seq").desc())


def alert_badge(alerts: DataFrame) -> DataFrame:
    """Errors, warnings and the badge text, which is empty when there are neither."""
    counted = alerts.agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    )
    text = F.format_string("⚠  %d ERR   %d WARN", "errors", "warnings")
    some = F.col("errors") + F.col("warnings") > 0
    return counted.withColumn("badge", F.when(some, text).otherwise(F.lit("")))


def with_alert_mark(games: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add ``has_alert``."""
    marked = alerts.select("game_id").distinct().withColumn("_hit", F.lit(True))
    return games.join(marked, "game_id", "left").withColumn("has_alert", F.col("_hit").isNotNull()).drop("_hit")


def only_with_issues(games: DataFrame, issues: DataFrame) -> DataFrame:
    """Games with an unresolved error or warning."""
    return games.join(unresolved(issues).select("game_id").distinct(), "game_id", "left_semi")


def only_watched(games: DataFrame, watchlist: DataFrame) -> DataFrame:
    return games.join(watchlist.select("game_id").distinct(), "game_id", "left_semi")


def no_longer_listed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Games of the previous snapshot that the current one lacks."""
    return previous.join(current.select("game_id").distinct(), "game_id", "left_anti")


def unresolved(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("severity").isin("ERROR", "WARNING"))
