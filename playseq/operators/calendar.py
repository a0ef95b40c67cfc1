"""Season calendar: weeks, their dates, and the games that fall in them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.functions.text import day_range
from playseq.operators.ranges import in_ranges
from playseq.operators.storage import BROADCAST_ROWS, local_table

REGULAR, POSTSEASON = 2, 3
CALENDAR_SCHEMA = "season int, week int, seasontype int, start_date date, end_date date"


@dataclass(frozen=True)
class Season:
    """A season opens with a short week 0 (three days); weeks 1 to ``weeks`` follow without gaps."""

    year: int
    opening: dt.date
    postseason: dt.date
    closing: dt.date
    weeks: int = 15

    def rows(self) -> list[tuple]:
        day = dt.timedelta(days=1)
        out = [(self.year, 0, REGULAR, self.opening, self.opening + 2 * day)]
        for week in range(1, self.weeks + 1):
            start = self.opening + (3 + 7 * (week - 1)) * day
            out.append((self.year, week, REGULAR, start, start + 6 * day))
        return [*out, (self.year, None, POSTSEASON, self.postseason, self.closing)]


# First day, first postseason day and last day of each season.
SEASONS = (
    Season(2025, dt.date(2025, 8, 23), dt.date(2025, 12, 9), dt.date(2026, 1, 15)),
    Season(2024, dt.date(2024, 8, 24), dt.date(2024, 12, 10), dt.date(2025, 1, 15)),
    Season(2023, dt.date(2023, 8, 26), dt.date(2023, 12, 11), dt.date(2024, 1, 15)),
)


def season_calendar(spark: SparkSession, seasons: tuple[Season, ...] = SEASONS) -> DataFrame:
    """One row per week, and one per postseason (week null): 17 rows per season."""
    return local_table(spark, [row for s in seasons for row in s.rows()], CALENDAR_SCHEMA)


def week_dates(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add the dates of the requested ``season``, ``week``, ``seasontype``; null when unknown.

    The postseason needs no week.
    """
    key = F.when(F.col("seasontype") == POSTSEASON, F.lit(-1)).otherwise(F.col("week"))
    right = calendar.select(
        "season", F.coalesce("week", F.lit(-1)).alias("_week"), "seasontype", "start_date", "end_date"
    ).withColumn("dates", day_range(F.col("start_date"), F.col("end_date")))
    # A calendar has 17 rows per season, so its size is known to be small.
    return requests.withColumn("_week", key).join(F.broadcast(right), ["season", "_week", "seasontype"], "left").drop("_week")


def games_in_weeks(games: DataFrame, calendar: DataFrame, day: Column) -> DataFrame:
    """Each game with every calendar row that contains its day (inclusive).

    Calendars of any size, with rows of any length that may overlap; see ``in_ranges``.
    """
    return in_ranges(games.withColumn("_day", day.cast("date")), calendar, "_day", "start_date", "end_date").drop("_day")


def games_on_days(games: DataFrame, calendar: DataFrame, day: Column) -> DataFrame:
    """Like :func:`games_in_weeks`, with the calendar spread to one row per day: an equality join."""
    days = calendar.withColumn("_day", F.explode(F.sequence("start_date", "end_date")))
    if days.count() <= BROADCAST_ROWS:
        days = F.broadcast(days)
    return games.withColumn("_day", day.cast("date")).join(days, "_day").drop("_day")


def games_of_week(
    games: DataFrame, calendar: DataFrame, *, league: str = "all", season: int, week: int | None = None, seasontype: int = REGULAR
) -> DataFrame:
    """Games of one week: pro games by their season columns, all others by date.

    ``games`` has ``league``, ``season``, ``week``, ``seasontype`` (landing columns) and ``game_date``.
    The dates are literals, so both branches filter the scan. An unknown week has no games.
    """
    pro = games.where((F.col("league") == "nfl") & (F.col("season") == season) & (F.col("seasontype") == seasontype))
    span = calendar.where((F.col("season") == season) & (F.col("seasontype") == seasontype))
    if seasontype == POSTSEASON:
        pro = pro if week is None else pro.where(F.col("week") == week)
    else:
        pro = pro.where(F.col("week") == week)
        span = span.where(F.col("week") == week)
    other = games.where(F.col("league") != "nfl")
    # At most one calendar row.
    dates = [(r.start_date, r.end_date) for r in span.select("start_date", "end_date").collect()]
    other = other.where(F.col("game_date").between(*dates[0])) if dates else other.where(F.lit(False))
    both = pro.unionByName(other)
    return both if league == "all" else both.where(F.col("league") == league)
