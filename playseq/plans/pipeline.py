"""The composed pipelines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.operators import alerts, checks, flags, scoring, summary
from playseq.operators.clock import fix_clocks, snap_clocks
from playseq.operators.field import fill_field_positions
from playseq.operators.mapping import map_plays
from playseq.operators.names import with_canonical_names
from playseq.operators.order import first_arrivals, in_play_order
from playseq.operators.sequence import GAME, Ordered
from playseq.operators.storage import filter_by_keys, merged, packed, unpacked, written
from playseq.sources import documents

HEADER_COLUMNS = ("status", "home_team_id", "home_team", "home_abbrev", "away_team_id", "away_team", "away_abbrev")
CONTEXT_COLUMNS = ("home_name", "away_name")


UNREADABLE = "unreadable document"
# Columns that steps read or change, besides the sequence: conversions and clocks of plays, clocks alone, then entries up to the
# repair of their scores.
CONVERSION_COLUMNS = ("period", "clock", "home_score", "away_score", "play_type_text", "score_value", "point_after_attempt")
CLOCK_COLUMNS = ("period", "clock", "play_type_text")
SCORE_COLUMNS = ("field_position", "gain", "home_score", "away_score", "down")


class Quality(NamedTuple):
    """Result of a quality run."""

    issues: DataFrame
    alerts: DataFrame
    summary: DataFrame


def headers_from_summaries(docs: DataFrame, overrides: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per game: teams with canonical names, abbreviations and status."""
    headers = documents.add_headers(docs).select("game_id", "league", *HEADER_COLUMNS)
    headers = with_canonical_names(headers, overrides, canonical, "home_team", "away_team", suffix="_canonical")
    return headers.withColumnsRenamed({"home_team_canonical": "home_name", "away_team_canonical": "away_name"})


def plays_from_summaries(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """Deduplicated plays in order, with the columns of their header."""
    raw = documents.explode_plays(docs, "game_id")
    plays = in_play_order(first_arrivals(documents.parse_plays(raw, "game_id")))
    # One row per game on the right; the left side is already partitioned by game.
    return plays.join(merged(headers), "game_id")


def entries_from_plays(plays: DataFrame, seq: Ordered = GAME, *carry: str) -> DataFrame:
    """Repair, map and flag ordered plays. The order of the steps matters.

    Conversions are inferred before scoring sides are read off them, clocks are fixed before snaps are
    estimated, positions are filled before scores lag, and gap rows exist before flags are set.
    """
    keep = [*seq.columns, *CONTEXT_COLUMNS, *carry]
    # Windows and sorts cost by the number of columns, the clock repair most of all.
    place = [*seq.columns, *seq.order]
    plays = packed(plays, [*place, *CONVERSION_COLUMNS])
    plays = packed(scoring.scoring_side(scoring.infer_conversions(plays, seq), seq), [*place, *CLOCK_COLUMNS])
    plays = unpacked(snap_clocks(fix_clocks(plays, seq), seq))
    entries = fill_field_positions(packed(map_plays(plays, *keep), [*place, *SCORE_COLUMNS]), seq)
    return finish_entries(scoring.scoreboard_lag(entries, seq), seq)


def finish_entries(entries: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Last part of the pipeline, on entries that show lagged scores."""
    entries = unpacked(scoring.repair_conversion_scores(entries, seq))
    # The run number only grows, so this is the same order, in which the rows already are.
    entries = scoring.insert_gap_rows(entries, seq.by("conversion_run", *seq.order))
    entries = seq.number(entries, "play_index").withColumn("play_index", F.col("play_index") - 1)
    return flags.flag_entries(entries, seq)


def game_headers(games: DataFrame, entries: DataFrame) -> DataFrame:
    """Per-game values next to the entries: final score of the last real entry."""
    return scoring.final_score(
        games, entries.where(~F.col("is_placeholder")), home="scored_home", away="scored_away"
    )


def process_summaries(docs: DataFrame, overrides: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and game headers of all readable summary documents, the newest one of each game.

    A document is one row, which bounds the plays of a game; no key has to be cut into slices.
    """
    # Written, because headers and plays are both read off them: else each would read, parse and sort all documents again.
    entries, headers = process_newest(written(documents.newest(documents.readable(docs), "game_id"), "newest"), overrides, canonical)
    return entries, game_headers(headers, entries)


def process_newest(docs: DataFrame, overrides: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from readable documents, one of each game, that are written already; headers come without scores."""
    headers = headers_from_summaries(docs, overrides, canonical)
    entries = entries_from_plays(plays_from_summaries(docs, headers), GAME, "league")
    return entries, headers


def list_games(scoreboards: DataFrame, *, league: str = "all", live_only: bool = False) -> DataFrame:
    """Games of the newest readable scoreboard documents."""
    games = documents.newest_games(written(scoreboards, "scoreboards"))
    if league != "all":
        games = games.where(F.col("league") == league)
    return games.where(F.col("status") == "in") if live_only else games


def check_games(
    games: DataFrame,
    entries: DataFrame,
    *,
    mode: str = "historical",
    seen: DataFrame | None = None,
    failed: DataFrame | None = None,
) -> Quality:
    """Check all games: issues with resolved severity, new alerts, and the summary row.

    ``games`` has ``game_id``; ``entries`` come from the pipeline. Entries and issues have several
    readers, so both are written once instead of being computed for each. ``failed`` holds the ids of games
    that could not be read or mapped, and perhaps a ``reason``: they count as games, raise an error each, and are
    never clean.
    """
    entries = written(entries, "entries")
    issues = GAME.over(entries, lambda df, seq: checks.check_entries(df, seq))
    issues = written(checks.resolve_severity(issues, mode=mode), "issues")
    counts = summary.play_counts(entries)
    fresh = alerts.new_alerts(issues, seen)
    columns = ["game_id", "severity", "type", "message"]
    listed = fresh.select(*columns)
    read = games
    if failed is not None:
        reason = F.min("reason") if "reason" in failed.columns else F.lit(UNREADABLE)
        failed = written(failed.groupBy("game_id").agg(reason.alias("reason")), "failed")
        read = filter_by_keys(games, failed, ["game_id"], keep=False)
        games = games.select("game_id").union(failed.select("game_id")).distinct()
        listed = listed.unionByName(alerts.failure_alerts(failed, F.col("reason")).select(*columns))
    if mode == "historical":
        listed = listed.unionByName(alerts.clean_game_alerts(read, issues, counts).select(*columns))
    return Quality(issues, listed, summary.summarise(games, counts, issues))


def check_documents(docs: DataFrame, overrides: DataFrame, canonical: DataFrame) -> Quality:
    """A historical quality run over summary documents, the newest one of each game, whatever is wrong with some.

    A game whose newest document cannot be read, or holds numbers that cannot be mapped, becomes an error alert with the
    reason and counts as a game; all others are mapped and checked as if it were not there.
    """
    docs = written(documents.newest(docs, "game_id"), "documents")
    broken = documents.unreadable(docs).select("game_id", F.lit(UNREADABLE).alias("reason"))
    readable = documents.readable(docs)
    failed = written(broken.unionByName(documents.unmappable(readable)), "failed")
    sound = filter_by_keys(readable, failed, ["game_id"], keep=False)
    entries, headers = process_newest(sound, overrides, canonical)
    return check_games(headers, entries, failed=failed)


def monitor_live(
    games: DataFrame, watchlist: DataFrame, entries: DataFrame, counts: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """New alerts of one live pass: stalled feeds and issues of watched games that are in progress.

    ``counts`` holds the play count of each game per snapshot (``game_id, fetched_at, play_count``).
    """
    live = alerts.only_watched(games.where(F.col("status") == "in"), watchlist).select("game_id")
    live = written(live, "live")
    # Written, because the checker reads the entries twice: to look for hot games and to check them.
    watched = written(filter_by_keys(entries, live, ["game_id"]), "watched")
    issues = checks.resolve_severity(GAME.over(watched, lambda df, seq: checks.check_entries(df, seq)))
    found = alerts.with_alert_keys(issues)
    stalled = checks.stalled_feeds(filter_by_keys(counts, live, ["game_id"]))
    columns = ["game_id", "severity", "type", "message", "alert_key", "play_index", "check_no"]
    stalled = stalled.withColumns({"play_index": F.lit(-1).cast("bigint"), "check_no": F.lit(0)})
    both = found.select(*columns).unionByName(stalled.select(*columns))
    fresh = alerts.first_per_key(both, ["alert_key"], alerts.ISSUE_ORDER)
    return fresh if seen is None else fresh.join(seen.select("alert_key"), "alert_key", "left_anti").select(*columns)
