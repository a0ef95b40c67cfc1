"""The second, richer checker (long form): one row per issue, with severity and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.functions.text import signed
from playseq.operators.flags import BUNDLED_DROPS, STUCK_ROWS, VALID_RISES, missing_conversions, score_changes, stuck_rows
from playseq.operators.sequence import GAME, Ordered

SCORE_ISSUES = ("score_regression", "invalid_score_jump", "missing_ep", "bundled_score_artifact")
ISSUE_COLUMNS = ("severity", "type", "message", "play_index", "check_no")
MISSING_POSITIONS_ALLOWED = 3

# Notes appended to issues that the repair has already dealt with.
AUTO_FIXED = {
    "live": "  [auto-fixed by pipeline — no red row]",
    "historical": "  [auto-fixed — no red row]",
}


def _issue(severity: str, kind: str, message: Column, index: Column, check: int) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(kind).alias("type"),
        message.alias("message"),
        index.cast("bigint").alias("play_index"),
        F.lit(check).alias("check_no"),
    )


def _score_issue(team: Column, delta: Column, index: Column, check: int) -> Column:
    at = F.concat(F.lit(" at play #"), (index + 1).cast("string"))
    size = F.abs(delta).cast("string")
    bundled = F.concat(team, F.lit(" bundled-score lag artifact ("), signed(delta), F.lit(")"), at)
    dropped = F.concat(team, F.lit(" score decreased by "), size, at)
    jumped = F.concat(team, F.lit(" score jumped by "), size, at, F.lit(" (unexpected value)"))
    return (
        F.when(delta.isin(*BUNDLED_DROPS), _issue("INFO", "bundled_score_artifact", bundled, index, check))
        .when(delta < 0, _issue("ERROR", "score_regression", dropped, index, check))
        .when(~delta.isin(*VALID_RISES), _issue("WARNING", "invalid_score_jump", jumped, index, check))
    )


def check_entries(df: DataFrame, seq: Ordered = GAME, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """All issues of all games in one pass over the entries.

    ``df`` has ``play_index`` (0-based), ``home_name`` and ``away_name``. Reports stuck clocks, drops and
    impossible rises of a score, touchdowns without conversion and many unknown field positions. When
    the entries carry ``qc_issue``, each issue gets the flag of the entry it points to.
    """
    index = F.col("play_index")
    if "qc_issue" not in df.columns:
        df = df.withColumn("qc_issue", F.lit(None).cast("string"))
    df = missing_conversions(score_changes(stuck_rows(df, seq), seq), seq)
    df = seq.shift(df, _prev_qc=(F.col("qc_issue"), 1))
    unknown = (F.col("field_position") == 0) & F.col("down").isin("1", "2", "3", "4")
    df = seq.total(df, _unknown=("sum", F.when(unknown, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))

    stuck_text = F.concat(
        F.lit("Clock stuck at "), F.col("clock"), F.lit(f" for {STUCK_ROWS}+ plays in Q"), F.col("quarter")
    )
    stuck = F.when(F.col("stuck_row") == STUCK_ROWS, _issue("WARNING", "stuck_clock", stuck_text, index, 1))

    on_kickoff = F.col("down") == "KO"
    at = F.when(on_kickoff, index - 1).otherwise(index)
    scorer = F.when(F.col("home_delta") == 6, F.col("home_name")).otherwise(F.col("away_name"))
    bare_text = F.concat(
        F.lit("TD by "), scorer, F.lit(" at play #"), (at + 1).cast("string"), F.lit(" — no EP or 2PT row follows")
    )
    bare = F.when(F.col("bare_touchdown"), _issue("WARNING", "missing_ep", bare_text, at, 4))

    many = (index == 0) & (F.col("_unknown") > MISSING_POSITIONS_ALLOWED)
    many_text = F.concat(F.col("_unknown").cast("string"), F.lit(" scrimmage plays have field_position=0 (missing data)"))
    positions = F.when(many, _issue("INFO", "missing_fp", many_text, F.lit(0), 5))

    found = F.array_compact(
        F.array(
            stuck,
            _score_issue(F.col("home_name"), F.col("home_delta"), index, 2),
            _score_issue(F.col("away_name"), F.col("away_delta"), index, 3),
            bare,
            positions,
        )
    )
    issues = df.withColumn("_issue", F.explode(found))
    points_back = F.col("_issue.play_index") < index
    flag = F.when(points_back, F.col("_prev_qc")).otherwise(F.col("qc_issue"))
    return issues.select(*seq.keys, *carry, *[F.col("_issue." + c).alias(c) for c in ISSUE_COLUMNS], flag.alias("entry_qc"))


def attach_entry_flags(issues: DataFrame, entries: DataFrame, seq: Ordered = GAME) -> DataFrame:
    """Add ``entry_qc``: the flag of the entry each issue points to, null when there is no such entry."""
    flags = entries.select(*seq.keys, "play_index", F.col("qc_issue").alias("entry_qc"))
    return issues.drop("entry_qc").join(flags, [*seq.keys, "play_index"], "left")


def resolve_severity(issues: DataFrame, *, mode: str = "live", note: str | None = None) -> DataFrame:
    """Downgrade issues that the repair has fixed to INFO, and say so in the message.

    Only clock and position issues qualify, and only if the entry they point to is known to be clean;
    score issues never do. Adds ``auto_fixed``.
    """
    fixed = (
        ~F.col("type").isin(*SCORE_ISSUES)
        & F.coalesce(F.col("entry_qc") == "", F.lit(False))
        & F.col("severity").isin("ERROR", "WARNING")
    )
    text = F.lit(AUTO_FIXED[mode] if note is None else note)
    return issues.withColumns(
        {
            "auto_fixed": fixed,
            "original_severity": F.col("severity"),
            "severity": F.when(fixed, F.lit("INFO")).otherwise(F.col("severity")),
            "message": F.when(fixed, F.concat(F.col("message"), text)).otherwise(F.col("message")),
        }
    )


def stalled_feeds(counts: DataFrame, seq: Ordered = Ordered(("game_id",), ("fetched_at",))) -> DataFrame:
    """Snapshots of a game whose play count (``play_count``, positive) is that of the snapshot before."""
    df = seq.shift(counts, _prev=(F.col("play_count"), 1))
    same = (F.col("_prev") > 0) & (F.col("_prev") == F.col("play_count"))
    count = F.col("play_count").cast("string")
    return df.where(same).select(
        *counts.columns,
        F.lit("INFO").alias("severity"),
        F.lit("stalled").alias("type"),
        F.concat(F.lit("Play count unchanged at "), count, F.lit(" plays since last poll")).alias("message"),
        F.concat_ws(":", F.col("game_id").cast("string"), F.lit("stalled"), count).alias("alert_key"),
    )
