"""Hand-written games for the branches the generated feeds do not reach."""

import pytest
from pyspark.sql import functions as F

from playseq.operators import checks, flags, scoring
from playseq.operators.clock import fix_clocks, repair_stuck_clocks, snap_clocks
from playseq.operators.field import fill_field_positions
from playseq.operators.mapping import map_plays
from playseq.operators.sequence import GAME
from playseq.plans.pipeline import entries_from_plays

PLAY = {
    "period": 1,
    "clock": "10:00",
    "play_type_text": "Rush",
    "play_type_id": 5,
    "description": "",
    "home_score": 0,
    "away_score": 0,
    "start_down": 1,
    "start_distance": 10,
    "yards_to_endzone": 60,
    "stat_yardage": 3,
    "scoring_play": False,
    "score_value": 0,
    "drive_team_id": "H",
    "end_down": 2,
    "point_after_attempt": None,
    "wallclock": "",
    "home_team_id": "H",
    "away_team_id": "A",
    "home_name": "Hawks",
    "away_name": "Wolves",
    "home_abbrev": "HWK",
    "away_abbrev": "WLV",
}
PLAY_SCHEMA = (
    "game_id string, ord bigint, period int, clock string, play_type_text string, play_type_id int, description string, "
    "home_score int, away_score int, start_down int, start_distance int, yards_to_endzone int, stat_yardage int, "
    "scoring_play boolean, score_value int, drive_team_id string, end_down int, "
    "point_after_attempt struct<text:string,value:int>, wallclock string, home_team_id string, away_team_id string, "
    "home_name string, away_name string, home_abbrev string, away_abbrev string"
)
ENTRY_SCHEMA = (
    "game_id string, ord bigint, home_score int, away_score int, clock string, quarter string, down string, distance int, "
    "gain int, field_position int, possession string, run_clock string, home_time_out string, away_time_out string, "
    "play_text string, wallclock string, home_name string, away_name string"
)
ENTRY = ("0:00", "1", "1", 10, 0, 20, "Hawks", "No", "No", "No", "", "", "Hawks", "Wolves")


@pytest.fixture
def plays(spark):
    def make(*games):
        rows = []
        for g, game in enumerate(games):
            for n, play in enumerate(game):
                rows.append((f"g{g}", n + 1, *{**PLAY, **play}.values()))
        return spark.createDataFrame(rows, PLAY_SCHEMA)

    return make


@pytest.fixture
def entries(spark):
    """Entries from (home, away, extra values by position name)."""
    names = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")][4:]

    def make(*rows):
        out = []
        for n, (home, away, *extra) in enumerate(rows):
            values = dict(zip(names, ENTRY)) | (extra[0] if extra else {})
            out.append(("g", n + 1, home, away, *values.values()))
        return spark.createDataFrame(out, ENTRY_SCHEMA)

    return make


def column(df, name):
    return [r[0] for r in df.orderBy("game_id", "ord").select(name).collect()]


def clocks(*values, period=1):
    return [{"clock": v, "period": period} for v in values]


def test_stuck_clock_is_interpolated(plays):
    game = clocks(*["10:00"] * 6, "9:00", "8:00")
    assert column(repair_stuck_clocks(plays(game)), "clock") == ["10:00", "9:50", "9:40", "9:30", "9:20", "9:10", "9:00", "8:00"]


def test_stuck_clock_without_a_later_value_runs_down_to_zero(plays):
    assert column(repair_stuck_clocks(plays(clocks(*["1:10"] * 6))), "clock") == ["1:10", "0:40", "0:10", "0:00", "0:00", "0:00"]


def test_stuck_clock_looks_past_rises_but_not_past_the_period(plays):
    rise = clocks(*["5:00"] * 6, "14:00", "5:00", "5:01", "4:00")
    split = clocks(*["5:00"] * 6, "14:00") + clocks("4:00", period=2)
    # Not a low of its period, followed by a rise: the search goes past 7:00 to 5:00.
    high = clocks("3:00", *["6:00"] * 6, "7:00", "6:00", "5:00", "1:00")
    out = repair_stuck_clocks(plays(rise, split, high))
    got = column(out, "clock")
    assert got[:6] == ["5:00", "4:50", "4:40", "4:30", "4:20", "4:10"]
    assert got[10:16] == ["5:00", "4:30", "4:00", "3:30", "3:00", "2:30"]
    assert got[19:25] == ["6:00", "5:50", "5:40", "5:30", "5:20", "5:10"]


def test_short_and_unreadable_clocks(plays):
    five = clocks("1:00", "9:00", "9:00", "9:00", "9:00")
    odd = clocks("9:00", "half", "8:00", "7:00", "6:00", "5:00")
    got = column(fix_clocks(plays(five, odd)), "clock")
    assert got[:5] == ["1:00", "9:00", "9:00", "9:00", "9:00"]
    # An unreadable clock counts as 0 and holds the rest of the period there.
    assert got[5:] == ["9:00", "half", "0:00", "0:00", "0:00", "0:00"]


def test_snap_clock_restarts_with_the_period(plays):
    game = clocks("14:58", "14:50") + clocks("14:59", "10:00", period=2)
    assert column(snap_clocks(plays(game)), "clock") == ["15:00", "14:57", "15:00", "10:07"]


def test_conversions_are_inferred_from_the_rise(plays):
    td = {"score_value": 6, "scoring_play": True, "play_type_text": "Rushing Touchdown"}
    good = [{}, {**td, "home_score": 7}, {"home_score": 7}]
    two = [{}, {**td, "away_score": 8}]
    missed = [{}, {**td, "home_score": 6}]
    separate = [{}, {**td, "home_score": 7}, {"home_score": 7}, {"play_type_text": "Extra Point Good", "home_score": 7}]
    stray = [{}, {**td, "home_score": 7}, {"home_score": 7, "play_type_text": "Patrol"}]
    out = scoring.infer_conversions(plays(good, two, missed, separate, stray))
    found = out.where("score_value = 6").orderBy("game_id").select("point_after_attempt.value").collect()
    assert [r[0] for r in found] == [1, 2, 0, None, None]


def test_scoring_side_looks_two_plays_ahead(plays):
    pat = {"text": "good", "value": 1}
    td = {"point_after_attempt": pat, "play_type_text": "Punt Return Touchdown", "score_value": 6}
    at_once = [td | {"away_score": 7}]
    one_late = [td, {"away_score": 7}]
    two_late = [td, {}, {"home_score": 7}]
    never = [td, {}, {}, {"home_score": 7}]
    out = scoring.scoring_side(plays(at_once, one_late, two_late, never))
    assert [r[0] for r in out.where("score_value = 6").orderBy("game_id").select("td_scoring_team").collect()] == [
        "away",
        "away",
        "home",
        None,
    ]


def test_conversion_rows_take_the_value_from_the_scorer(plays):
    pick_six = [{}, {"play_type_text": "Interception Touchdown", "score_value": 6, "away_score": 7, "drive_team_id": "H"}]
    rows = map_plays(scoring.scoring_side(scoring.infer_conversions(plays(pick_six))), "game_id").orderBy("ord").collect()
    assert [(r.down, r.home_score, r.away_score) for r in rows] == [("1", 0, 0), ("1", 0, 6), ("EP", 0, 7)]


def test_timeout_by_type_id_and_run_clock(plays):
    game = [
        {"play_type_text": "Official", "play_type_id": 21, "description": "charged to wlv"},
        {"play_type_text": "Two Point Rush"},
        {"end_down": 1},
        {"end_down": None},
        {"scoring_play": True},
    ]
    rows = map_plays(plays(game).withColumn("td_scoring_team", F.lit(None).cast("string")), "game_id").orderBy("ord").collect()
    assert [r.run_clock for r in rows] == ["No", "Yes", "No", "Yes", "No"]
    assert (rows[0].home_time_out, rows[0].away_time_out, rows[0].gain) == ("No", "Yes", 0)


def test_field_position_chain(entries):
    def fp(position, gain):
        return 0, 0, {"field_position": position, "gain": gain}

    df = entries(fp(0, 5), fp(30, 10), fp(0, 5), fp(0, 20), fp(0, 1), fp(-45, 5), fp(0, -60), fp(0, 3), fp(60, 10), fp(0, 0))
    # 30 -> 20 -> 15 -> 0 (ends); 55 -> 50 -> 100 (ends); 60 -> 50.
    assert column(fill_field_positions(df), "field_position") == [0, 30, 20, 15, 0, -45, -50, 0, 60, -50]


def test_adjacent_conversions_use_the_repaired_row(entries):
    ep = {"down": "EP"}
    df = entries((7, 7), (6, 8, ep), (6, 9, ep), (5, 10, ep), (4, 3))
    rows = scoring.repair_conversion_scores(df).orderBy("ord").collect()
    assert [(r.home_score, r.away_score) for r in rows] == [(7, 7), (7, 7), (7, 8), (7, 8), (4, 3)]
    assert rows[1].fix_note.endswith("(home restored +1)") and rows[4].fix_note == ""


def test_gap_rows_only_before_opening_kickoffs(entries):
    ko2, q2 = {"down": "KO", "quarter": "2"}, {"quarter": "2"}
    df = entries((0, 0), (0, 0, ko2), (7, 3, q2), (7, 3, {"down": "KO", "quarter": "3"}))
    rows = scoring.insert_gap_rows(df).orderBy("ord").collect()
    assert [r.down for r in rows] == ["1", "?", "KO", "1", "KO"]
    assert "(Hawks +7, Wolves +3)" in rows[1].play_text and rows[1].quarter == "1" and rows[1].clock == "0:00"


def test_row_can_miss_two_conversions(entries):
    df = entries((0, 0), (6, 0), (12, 0, {"down": "KO"}), (12, 0))
    assert column(flags.flag_entries(df), "qc_issue")[1] == "Missing EP after TD · Missing EP after TD"


def test_opening_kickoff_suppresses_only_the_flag(entries):
    df = entries((0, 0), (0, 0, {"down": "KO", "quarter": "2"}), (6, 0, {"quarter": "2"}), (6, 0, {"quarter": "2"}))
    assert column(flags.flag_entries(df), "qc_issue") == ["", "", "", ""]
    issues = checks.check_entries(df.withColumn("play_index", F.col("ord") - 1)).collect()
    assert [(i.type, i.play_index) for i in issues] == [("missing_ep", 2)]


def test_severity_of_stale_flags(entries):
    same = {"clock": "3:00"}
    df = entries(*[(0, 0, same)] * 4, (5, 0)).withColumn("play_index", F.col("ord") - 1)
    clean = checks.resolve_severity(checks.check_entries(df.withColumn("qc_issue", F.lit(""))), note=" (fixed)").collect()
    by_type = {i.type: i for i in clean}
    assert by_type["stuck_clock"].severity == "INFO" and by_type["stuck_clock"].message.endswith(" (fixed)")
    assert by_type["invalid_score_jump"].severity == "WARNING"
    unknown = checks.resolve_severity(checks.check_entries(df)).collect()
    assert all(not i.auto_fixed for i in unknown)


def test_pipeline_ignores_input_order_and_partitions(plays):
    game = [
        {"clock": f"{14 - i}:00", "home_score": 7 * (i // 4), "play_type_text": "Rushing Touchdown" if i % 4 == 0 else "Rush"}
        | ({"score_value": 6} if i % 4 == 0 else {})
        for i in range(12)
    ]
    df = plays(game, game[::2])
    one = entries_from_plays(df.coalesce(1), GAME)
    other = entries_from_plays(df.orderBy(F.rand(3)).repartition(7), GAME)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(one.columns).collect()))


def test_clock_never_rises_and_conversion_rows_add_up(spark):
    from playseq.plans.catalog import QUERIES
    from tests.conftest import SF

    rows = QUERIES["fixed_clock"](spark, SF).orderBy("game_id", "ord").collect()
    long_games = {r.game_id for r in rows if r.ord >= 6}

    def seconds(clock):
        minutes, rest = clock.split(":")
        return int(minutes) * 60 + int(rest)

    for a, b in zip(rows, rows[1:]):
        if a.game_id == b.game_id and a.period == b.period and a.game_id in long_games:
            assert seconds(b.clock) <= seconds(a.clock)


def test_score_repair_of_a_long_run(spark):
    """One game of adjacent conversion rows, whole and cut into slices, against a plain loop."""
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).alias("game_id"),
        (F.col("id") + 1).alias("ord"),
        F.lit("EP").alias("down"),
        (F.col("id") / 3 - F.col("id") % 5).cast("int").alias("home_score"),
        (F.col("id") / 4 + F.col("id") % 7).cast("int").alias("away_score"),
    )
    want, last = [], None
    for r in rows.orderBy("ord").collect():
        home, away = r.home_score, r.away_score
        if last and home < last[0] and away >= last[1]:
            home, away = last[0], home + away - last[0]
        elif last and away < last[1] and home >= last[0]:
            home, away = home + away - last[1], last[1]
        last = (home, away)
        want.append(last)
    whole = scoring.repair_conversion_scores(rows)
    cut, ordered = GAME.slice(rows, 20_000)
    for found in (whole, scoring.repair_conversion_scores(cut, ordered)):
        assert [tuple(r) for r in found.orderBy("ord").select("home_score", "away_score").collect()] == want
