"""One DuckDB statement per query of the catalogue."""

from __future__ import annotations

from playseq.plans import oracles as O
from playseq.plans.oracles import ENTRY, With, has, position, seconds, text

SQL: dict[str, str] = {}


def on_feed(name: str, select: str, *steps) -> None:
    """A statement over the play feed; each step takes and returns a table name."""
    q = With()
    source = O.feed(q)
    for step in steps:
        source = step(q, source)
    SQL[name] = q.select(select.format(src=source))


def on_entries(name: str, select: str, *steps) -> None:
    q = With()
    source = O.entryfeed(q)
    for step in steps:
        source = step(q, source)
    SQL[name] = q.select(select.format(src=source))


def _index(q: With, src: str) -> str:
    return q.add("idx", f"SELECT *, ord - 1 AS play_index FROM {src}")


def _entry_issues(q: With, src: str) -> str:
    return O.issues(q, _index(q, src))


def _stale_qc(q: With, src: str) -> str:
    return q.add("stale_qc", f"SELECT game_id, ord - 1 AS play_index, CASE WHEN ord % 2 = 0 THEN '' ELSE 'stale' END AS qc_issue FROM {src}")


# -- scalars and classification

_back = f"(CASE WHEN {position('yards_to_endzone')} < 0 THEN 100 + {position('yards_to_endzone')} ELSE {position('yards_to_endzone')} END)"
on_feed(
    "clock_parse_format",
    f"""SELECT game_id, ord, clock, {seconds('clock')} AS secs, {O.clock(seconds('clock'))} AS again,
    {O.clock('(' + seconds('clock') + ' - 60)')} AS minute_later, {seconds('description')} AS no_clock FROM {{src}}""",
)
on_feed("play_duration", f"SELECT game_id, ord, play_type_text, {O.duration('play_type_text')} AS seconds FROM {{src}}")
on_feed(
    "field_position",
    f"""SELECT game_id, ord, yards_to_endzone, {position('yards_to_endzone')} AS field_position, {_back} AS yards_back,
    greatest(0, least(100, {_back} - stat_yardage)) AS after_gain, printf('%+d', stat_yardage) AS gain_text FROM {{src}}""",
)
_skip = "'end period', 'end of half', 'end of game', 'coin toss', 'two-minute warning', 'officials time out'"
_real = f"(play_id <> '' AND lower(play_type_text) NOT IN ({_skip}) AND NOT {has('description', 'official timeout', 'officials time out')})"
_flags = "is_kickoff, is_timeout, is_punt, is_field_goal, is_extra_point, is_two_point, is_rush, is_pass, is_sack"
on_feed(
    "play_flags",
    f"SELECT game_id, ord, {_real} AS real_play, CASE WHEN period <= 4 THEN CAST(period AS VARCHAR) ELSE 'OT' END AS quarter, {_flags} FROM {{src}}",
    O.flagged,
)
on_feed(
    "possession_down_runclock",
    "SELECT game_id, ord, possession, down, distance, gain, field_position, run_clock FROM {src}",
    O.situated,
)
on_feed(
    "timeout_side",
    "SELECT game_id, ord, description, home_time_out, away_time_out FROM {src} WHERE is_timeout",
    O.situated,
)
on_feed(
    "order_and_dedup",
    f"""SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY sequence_number, grp, dpos, ppos) AS ord, play_id, is_copy,
    sequence_number FROM (
      SELECT * FROM (
        SELECT game_id, play_id, ord // 2 AS sequence_number, 0 AS grp, ord // 6 AS dpos, ord % 6 AS ppos, FALSE AS is_copy FROM {{src}} WHERE {_real}
        UNION ALL
        SELECT game_id, play_id, ord // 2, CASE WHEN CAST(play_id AS BIGINT) % 10 = 0 THEN 0 ELSE 1 END,
        CASE WHEN CAST(play_id AS BIGINT) % 10 = 0 THEN -1 ELSE ord // 6 END, ord % 6, TRUE FROM {{src}}
        WHERE CAST(play_id AS BIGINT) % 5 = 0 AND {_real})
      QUALIFY row_number() OVER (PARTITION BY game_id, play_id ORDER BY grp, dpos, ppos) = 1)""",
)

# -- sequence operators on plays

on_feed("infer_pat", "SELECT game_id, ord, pat_text, pat_value FROM {src}", O.infer)
on_feed(
    "scoring_side",
    "SELECT game_id, ord, pat_text, pat_value, td_scoring_team FROM {src} WHERE pat_value IS NOT NULL",
    O.infer,
    O.side,
)
on_feed("stuck_clock_repair", "SELECT game_id, ord, period, clock_before, clock FROM {src}", O.stuck)
on_feed("monotone_clock", "SELECT game_id, ord, period, clock_in AS clock_before, clock FROM {src}", O.monotone)
on_feed(
    "fixed_clock",
    "SELECT game_id, ord, period, clock_before, clock FROM {src}",
    O.stuck,
    lambda q, src: q.add("plain", f"SELECT game_id, ord, period, clock_before, clock FROM {src}"),
    O.monotone,
)
on_feed("snap_clock", "SELECT game_id, ord, period, clock_end AS clock_before, clock FROM {src}", O.snap)
on_feed("pat_split_rows", f"SELECT game_id, ord, {ENTRY} FROM {{src}}", O.infer, O.side, O.split_pats)

# -- sequence operators on entries

_ALL_GAMES = "(SELECT user_id AS game_id FROM events UNION SELECT c_custkey FROM customer)"


on_entries("fill_field_position", "SELECT game_id, ord, position_before, field_position FROM {src}", O.fill)
on_entries("scoreboard_lag", "SELECT game_id, ord, home_score, away_score FROM {src}", O.lagged)
on_entries(
    "final_score",
    f"""SELECT game_id, coalesce(h, 0) AS actual_home, coalesce(a, 0) AS actual_away FROM {_ALL_GAMES}
    LEFT JOIN (SELECT game_id, arg_max(home_score, ord) AS h, arg_max(away_score, ord) AS a FROM {{src}} GROUP BY 1)
    USING (game_id)""",
)
on_entries("ep_autofix", "SELECT game_id, ord, down, home_score, away_score, fix_note FROM {src}", O.autofix)
on_entries("gap_placeholders", f"SELECT game_id, ord, {ENTRY}, is_placeholder, gap_note FROM {{src}}", O.gaps)
on_entries("gap_count", "SELECT game_id, count(*) FILTER (is_placeholder) AS gaps FROM {src} GROUP BY game_id", O.gaps)
on_entries("qc_score_delta", "SELECT game_id, ord, home_score_flag, away_score_flag FROM {src}", O.wide_flags)
on_entries("qc_stuck", "SELECT game_id, ord, clock, stuck_flag FROM {src}", O.wide_flags)
on_entries("qc_missing_ep", "SELECT game_id, ord, conversion_flag, earlier_conversion_flag FROM {src}", O.wide_flags)
on_entries("qc_issue_text", "SELECT game_id, ord, qc_issue FROM {src}", O.issue_text)
on_entries("check_issues", "SELECT game_id, severity, type, message, play_index, check_no FROM {src}", _entry_issues)


def _resolved(mode: str):
    def step(q: With, src: str) -> str:
        _stale_qc(q, src)
        _entry_issues(q, src)
        return O.resolved(q, "stale_qc", mode)

    return step


on_entries(
    "resolve_severity",
    "SELECT game_id, severity, type, message, play_index, check_no, entry_qc, auto_fixed, original_severity FROM {src}",
    _resolved("live"),
)
on_entries("resolve_severity_historical", "SELECT game_id, severity, type, message FROM {src}", _resolved("historical"))

# -- alerts and game lists

_KEY = "game_id || ':' || type || ':' || message"
on_entries(
    "alert_dedup",
    f"""SELECT game_id, severity, type, message, play_index, check_no, {_KEY} AS alert_key FROM (
      SELECT * FROM {{src}} UNION ALL SELECT * REPLACE (check_no + 10 AS check_no) FROM {{src}} WHERE play_index % 3 = 0)
    WHERE {_KEY} NOT IN (SELECT {_KEY} FROM {{src}} WHERE game_id % 7 = 0)
    QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY play_index, check_no) = 1""",
    _entry_issues,
)
on_entries(
    "alert_counts",
    """SELECT e AS errors, w AS warnings, CASE WHEN e + w > 0 THEN '⚠  ' || e || ' ERR   ' || w || ' WARN' ELSE '' END AS badge FROM (
      SELECT count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARNING') AS w FROM {src})""",
    _entry_issues,
)
on_entries(
    "alert_feed",
    """SELECT strftime(t, '%H:%M:%S') AS time, strftime(t, '%I:%M:%S %p') AS time12, severity, message, game_id,
    game_id * 1000000 + play_index * 10 + check_no AS alert_seq FROM (
      SELECT i.*, strptime(e.wallclock, '%Y-%m-%dT%H:%M:%S') AS t, e.ord AS row_at FROM {src} i JOIN idx e ON e.game_id = i.game_id
      AND e.play_index = i.play_index + CASE WHEN i.type = 'missing_ep' AND EXISTS (
          SELECT 1 FROM deltas d WHERE d.game_id = i.game_id AND d.play_index = i.play_index + 1 AND d.bare AND d.down = 'KO'
          AND i.message = 'TD by ' || CASE WHEN d.hd = 6 THEN d.home_name ELSE d.away_name END || ' at play #' || (i.play_index + 1)
              || ' — no EP or 2PT row follows') THEN 1 ELSE 0 END)""",
    _entry_issues,
)
_GAMES = "(SELECT DISTINCT user_id AS game_id FROM events)"
on_entries(
    "clean_games",
    f"""SELECT game_id, 'OK' AS severity, 'ok' AS type, 'No issues found — ' || (SELECT count(*) FROM entryfeed e WHERE e.game_id = g.game_id)
    || ' plays checked' AS message FROM {_ALL_GAMES} g
    WHERE NOT EXISTS (SELECT 1 FROM {{src}} i WHERE i.game_id = g.game_id)""",
    _entry_issues,
)
on_entries(
    "issue_games",
    f"""SELECT game_id FROM {_ALL_GAMES} g WHERE EXISTS (SELECT 1 FROM {{src}} i WHERE i.game_id = g.game_id AND i.severity IN ('ERROR', 'WARNING'))""",
    _entry_issues,
)
on_entries(
    "has_alert",
    f"SELECT game_id, game_id IN (SELECT game_id FROM {{src}}) AS has_alert FROM {_ALL_GAMES}",
    _entry_issues,
)
SQL["stale_games"] = """SELECT DISTINCT user_id AS game_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'
EXCEPT SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11'"""
SQL["watched_games"] = f"SELECT game_id FROM {_GAMES} WHERE game_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)"


def _summary_of_entries() -> str:
    q = With()
    _entry_issues(q, O.entryfeed(q))
    q.add("resolved", "SELECT * FROM issues")
    q.add("games", _GAMES[1:-1])
    return O.summary(q, "games", "entryfeed")


SQL["qc_summary"] = _summary_of_entries()

_DAILY = """WITH daily AS (SELECT user_id AS game_id, CAST(ts AS DATE) AS day, count(*) AS plays FROM events GROUP BY ALL),
days AS (SELECT game_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY game_id),
counts AS (SELECT game_id, CAST(day AS TIMESTAMP) AS fetched_at,
  CAST((SELECT sum(plays) FROM daily x WHERE x.game_id = days.game_id AND x.day <= days.day) AS BIGINT) AS play_count FROM days),
stalls AS (SELECT game_id, fetched_at, play_count, 'INFO' AS severity, 'stalled' AS type,
  'Play count unchanged at ' || play_count || ' plays since last poll' AS message, game_id || ':stalled:' || play_count AS alert_key
  FROM counts QUALIFY play_count > 0 AND play_count = lag(play_count) OVER (PARTITION BY game_id ORDER BY fetched_at))"""
SQL["stalled_feed"] = _DAILY + " SELECT * FROM stalls"
on_entries("play_count", "SELECT game_id, count(*) AS play_count FROM {src} GROUP BY game_id")

# -- lookups

_TITLE = "(upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2))"
_FIRST = "(upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2))"
_NAMES = f"""WITH teams AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'nfl' ELSE 'cfb' END AS league,
  CASE WHEN p_size % 10 = 0 THEN upper(p_name) ELSE {_TITLE} || ' ' || p_type END AS name FROM part),
known AS (SELECT DISTINCT p_name FROM part WHERE p_name NOT LIKE '%blue%'),
special AS (SELECT DISTINCT {_TITLE} || ' ' || p_type AS s, upper(p_name) AS t FROM part WHERE p_type = 'ECONOMY' AND p_name LIKE 'small%'
  UNION SELECT DISTINCT {_FIRST}, upper({_FIRST}) || ' OTHER' FROM part WHERE p_name LIKE 'blue%' OR p_name LIKE 'red%'),
raw AS (SELECT DISTINCT league, name, string_split(name, ' ') AS w FROM teams),
pieces AS (SELECT league, name, unnest(generate_series(len(w), CASE WHEN league = 'nfl' THEN len(w) ELSE 1 END, -1)) AS n, w, len(w) AS full_len FROM raw),
tries AS (SELECT *, array_to_string(w[1:n], ' ') AS cand FROM pieces),
hits AS (SELECT league, name, t AS canonical_name, n * 2 + CASE WHEN n = full_len THEN 1 ELSE 0 END AS rank FROM tries JOIN special ON s = cand WHERE league <> 'nfl'
  UNION ALL SELECT league, name, p_name, n * 2 + CASE WHEN n = full_len THEN 0 ELSE 1 END FROM tries JOIN known ON p_name = lower(cand)),
best AS (SELECT league, name, arg_max(canonical_name, rank) AS canonical_name FROM hits GROUP BY ALL)"""
SQL["canonical_names"] = _NAMES + " SELECT * FROM best"
SQL["canonical_or_raw"] = _NAMES + " SELECT p_partkey, league, name, coalesce(canonical_name, name) AS name_canonical FROM teams LEFT JOIN best USING (league, name)"

_CALENDAR = """WITH years AS (SELECT CAST(range AS INTEGER) AS y FROM range(1994, 2002)),
weeks AS (SELECT y AS season, CAST(range AS INTEGER) AS week, 2 AS seasontype,
    make_date(y, 8, 23) + CAST(CASE WHEN range = 0 THEN 0 ELSE 3 + 7 * (range - 1) END AS INTEGER) AS start_date,
    make_date(y, 8, 23) + CAST(CASE WHEN range = 0 THEN 2 ELSE 9 + 7 * (range - 1) END AS INTEGER) AS end_date FROM years, range(0, 16)
  UNION ALL SELECT y, NULL, 3, make_date(y, 12, 9), make_date(y + 1, 1, 15) FROM years)"""
_WEEKS = "SELECT o_orderkey AS game_id, season, coalesce(week, -1) AS week, seasontype, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date FROM orders JOIN weeks ON CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date"
SQL["week_games_range"] = f"{_CALENDAR} {_WEEKS}"
SQL["week_games_days"] = f"{_CALENDAR} {_WEEKS}"
SQL["week_date_ranges"] = f"""{_CALENDAR}, asked AS (SELECT o_orderkey AS request_id, CAST(year(o_orderdate) AS INTEGER) AS season,
  CAST(o_orderkey % 18 AS INTEGER) AS week, CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 2 END AS seasontype FROM orders)
SELECT request_id, a.season, a.week, a.seasontype, strftime(start_date, '%Y%m%d') || '-' || strftime(end_date, '%Y%m%d') AS dates
FROM asked a LEFT JOIN weeks w ON w.season = a.season AND w.seasontype = a.seasontype AND (a.seasontype = 3 OR w.week = a.week)"""
SQL["range_counts"] = """WITH p AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 211 ELSE o_orderkey % 7 - 1 END AS INTEGER) AS b FROM orders)
SELECT o_orderkey, count(*) AS days, CAST(sum(n) AS BIGINT) AS lines FROM r JOIN p ON day BETWEEN a AND b GROUP BY o_orderkey"""
_SCHEDULE = """schedule AS (SELECT o_orderkey AS game_id, CASE WHEN o_orderstatus = 'O' THEN 'nfl' ELSE 'cfb' END AS league,
  CASE WHEN o_orderstatus = 'P' THEN 'in' ELSE 'post' END AS status, CAST(year(o_orderdate) AS INTEGER) AS season,
  CAST(dayofyear(o_orderdate) // 20 AS INTEGER) AS week, 2 AS seasontype, CAST(o_orderdate AS DATE) AS gd, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS game_date FROM orders)"""
SQL["season_partition"] = f"""{_CALENDAR}, {_SCHEDULE}
SELECT * EXCLUDE (gd) FROM schedule WHERE league = 'nfl' AND season = 1998 AND week = 5
UNION ALL SELECT s.* EXCLUDE (gd) FROM schedule s, weeks w WHERE league <> 'nfl' AND w.season = 1998 AND w.week = 5 AND gd BETWEEN start_date AND end_date"""
SQL["season_postseason"] = f"""{_CALENDAR}, {_SCHEDULE}
SELECT s.* EXCLUDE (gd) FROM schedule s, weeks w WHERE league = 'cfb' AND w.season = 1997 AND w.seasontype = 3 AND gd BETWEEN start_date AND end_date"""
SQL["live_league_games"] = f"WITH {_SCHEDULE} SELECT game_id, league, status FROM schedule WHERE league = 'cfb' AND status = 'in'"

# -- read models

_NATIONS = """WITH g AS (SELECT o_orderkey AS game_id, 'Team of ' || h.n_name AS home, 'Team of ' || a.n_name AS away,
  CASE WHEN o_orderkey % 40 = 0 THEN 'postponed' WHEN o_orderstatus = 'O' THEN 'pre' WHEN o_orderstatus = 'F' THEN 'post' ELSE 'in' END AS status,
  CAST(floor(o_totalprice % 50) AS INTEGER) AS hs, CAST(floor((o_totalprice / 50) % 50) AS INTEGER) AS aws
  FROM orders JOIN nation h ON h.n_nationkey = o_orderkey % 25 JOIN nation a ON a.n_nationkey = (o_orderkey // 25) % 25)"""
SQL["matchups"] = f"""{_NATIONS} SELECT game_id, status,
CASE WHEN status IN ('in', 'post') THEN away || ' ' || aws || '  ' || hs || ' ' || home ELSE away || ' @ ' || home END AS matchup,
CASE status WHEN 'pre' THEN 'Scheduled' WHEN 'in' THEN 'LIVE' WHEN 'post' THEN 'Final' ELSE status END AS status_label,
CASE status WHEN 'in' THEN 'live' WHEN 'post' THEN 'final' ELSE 'pre' END AS tag,
away[1:16] || ' @ ' || home[1:16] AS list_label, away[1:12] || ' / ' || home[1:12] AS alert_label FROM g"""
SQL["live_game_count"] = f"""{_NATIONS} SELECT count(*) AS games, count(*) || ' live game' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS games_text
FROM g WHERE status = 'in'"""
_PARITY = "CASE WHEN play_index % 2 = 1 THEN 'odd' ELSE 'even' END"
_CLASSES = f"""CASE WHEN down = 'KO' THEN 'ko' WHEN down IN ('EP', '2PT') THEN 'ep' WHEN quarter = 'OT' THEN 'ot' WHEN quarter = '4' THEN 'q4'
WHEN quarter = '3' THEN 'q3' ELSE {_PARITY} END AS row_class, CASE WHEN qc_issue <> '' THEN 'flagged' ELSE {_PARITY} END AS monitor_class"""
_LOG = ENTRY.removesuffix(", wallclock")
on_entries(
    "play_log", f"SELECT game_id, play_index + 1 AS play_no, {_LOG}, qc_issue, {_CLASSES} FROM {{src}}", O.indexed, O.issue_text
)
on_entries(
    "row_class",
    f"SELECT row_class, monitor_class, count(*) AS rows FROM (SELECT {_CLASSES} FROM {{src}}) GROUP BY ALL",
    O.indexed,
    O.issue_text,
)
on_entries("latest_play", f"SELECT game_id, ord, {ENTRY} FROM {{src}} QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ord DESC) = 1")
on_entries(
    "scoreboard_line",
    """SELECT game_id, 'Wolves  ' || arg_max(away_score, ord) || '  —  ' || arg_max(home_score, ord) || '  Hawks     [' ||
    CASE game_id % 3 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'Final' ELSE 'Scheduled' END || ']' AS score_line FROM {src} GROUP BY game_id""",
)

# -- snapshots


def _weekly(q: With, src: str) -> str:
    return q.add(
        "weekly",
        f"""SELECT game_id, CAST(date_trunc('week', strptime(wallclock, '%Y-%m-%dT%H:%M:%S')) AS TIMESTAMP) AS fetched_at, ord,
        home_score, away_score FROM {src}""",
    )


on_entries(
    "latest_snapshot",
    "SELECT * FROM {src} w WHERE fetched_at = (SELECT max(fetched_at) FROM {src} x WHERE x.game_id = w.game_id)",
    _weekly,
)
SQL["current_game_list"] = """SELECT DISTINCT user_id AS game_id, event_type AS league, CAST(dayofmonth(ts) AS INTEGER) AS batch_id FROM events e
WHERE dayofmonth(ts) = (SELECT max(dayofmonth(ts)) FROM events x WHERE x.event_type = e.event_type)"""
SQL["current_game_list_all"] = """SELECT DISTINCT user_id AS game_id, CAST(dayofmonth(ts) AS INTEGER) AS batch_id FROM events
WHERE dayofmonth(ts) = (SELECT max(dayofmonth(ts)) FROM events)"""
on_entries(
    "game_version",
    """SELECT c_custkey AS game_id, coalesce((SELECT max(epoch(fetched_at)) FROM {src} w WHERE w.game_id = c_custkey), 0.0) AS version FROM customer""",
    _weekly,
)
on_entries(
    "changed_games",
    """SELECT game_id, CAST(epoch(TIMESTAMP '2024-01-24') AS DOUBLE) AS version, CAST(max(epoch(fetched_at)) AS DOUBLE) AS new_version FROM {src}
    GROUP BY game_id HAVING max(fetched_at) > TIMESTAMP '2024-01-24'""",
    _weekly,
)
on_entries(
    "entry_changes",
    """SELECT * FROM (SELECT game_id, ord AS play_index,
      CASE WHEN ord = 1 THEN 'added' WHEN ord % 9 = 0 THEN 'removed' WHEN ord % 7 = 0 THEN 'changed' END AS change,
      CASE WHEN ord > 1 THEN home_score END AS home_before,
      CASE WHEN ord % 9 <> 0 THEN home_score + CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END END AS home_after FROM {src}) WHERE change IS NOT NULL""",
)

on_entries(
    "entry_alignment",
    """SELECT * FROM (SELECT game_id, 'p' || ord AS play_id, slot,
      CASE WHEN NOT had THEN 'added' WHEN NOT has THEN 'removed' WHEN ord % 13 = 0 AND ord % 7 = 0 THEN 'moved, changed'
           WHEN ord % 13 = 0 THEN 'moved' WHEN ord % 7 = 0 THEN 'changed' END AS change,
      CASE WHEN had THEN ord END AS old_place, CASE WHEN has THEN ord + CASE WHEN ord % 13 = 0 THEN 1000 ELSE 0 END END AS new_place,
      CASE WHEN had THEN home_score END AS home_before, CASE WHEN has THEN home_score + CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END END AS home_after
      FROM (SELECT *, ord % 11 <> 0 AS had, ord % 9 <> 0 AND NOT (slot = 1 AND ord % 15 = 0) AS has
        FROM {src}, (VALUES (0), (1)) AS s(slot) WHERE slot = 0 OR ord % 5 = 0) WHERE had OR has) WHERE change IS NOT NULL""",
)

# -- documents: the flattened result straight from the tables

_GAME = """CAST(key AS VARCHAR) AS game_id, 'Team HOM ' || o_custkey AS home_team, 'HOM' AS home_abbrev,
CASE WHEN key % 4 = 3 THEN 0 ELSE points END AS home_score, key || 'HOM' AS home_team_id, 'Team AWY ' || o_custkey AS away_team,
'AWY' AS away_abbrev, CASE WHEN key % 4 = 3 THEN 0 ELSE points END AS away_score, key || 'AWY' AS away_team_id,
CASE WHEN key % 6 = 0 THEN 'pre' ELSE 'in' END AS status, CASE WHEN key % 6 = 0 THEN '' ELSE detail END AS status_detail,
CAST(CASE WHEN key % 6 = 0 THEN 0 ELSE key % 4 + 1 END AS INTEGER) AS period, CASE WHEN key % 6 = 0 THEN '0:00' ELSE '7:30' END AS clock,
CASE WHEN key % 2 <> 0 THEN '' WHEN key % 3 = 0 THEN 'SN' WHEN key % 3 = 1 THEN 'Long' ELSE '' END AS conference,
strftime(o_orderdate, '%Y-%m-%dT%H:%MZ') AS date, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS game_date"""
_POINTS = "o_orderkey AS key, CAST(floor(o_totalprice % 60) AS INTEGER) AS points"
SQL["json_games"] = f"""WITH o AS (SELECT *, {_POINTS}, 'now' AS detail FROM orders)
SELECT 'cfb' AS league, {_GAME} FROM o WHERE key % 15 <> 7 AND key % 50 <> 49"""
# A folder keeps its older file only if the newer one has nothing that can be read.
SQL["json_week_games"] = f"""{_CALENDAR}, {_SCHEDULE},
o AS (SELECT o.*, {_POINTS}, s.league, s.season, s.week, s.gd, key % 50 <> 49 AS good, key % 13 <> 0 AS listed
  FROM orders o JOIN schedule s ON s.game_id = o_orderkey),
f AS (SELECT *, bool_or(good AND listed) OVER (PARTITION BY league, season, week) AS renewed FROM o),
g AS (SELECT league, season, 2 AS seasontype, week, gd, {_GAME}
  FROM (SELECT *, CASE WHEN renewed THEN 'now' ELSE 'old' END AS detail FROM f) WHERE good AND (listed OR NOT renewed) AND key % 15 <> 7)
SELECT * EXCLUDE (gd) FROM g WHERE league = 'nfl' AND season = 1998 AND week = 5
UNION ALL SELECT g.* EXCLUDE (gd) FROM g, weeks w WHERE league <> 'nfl' AND w.season = 1998 AND w.week = 5 AND gd BETWEEN start_date AND end_date"""
SQL["json_dead_letters"] = """SELECT o_orderkey AS game_id, 'ERROR' AS severity, 'fetch_failed' AS type,
'Failed to fetch plays: unreadable document' AS message FROM orders WHERE o_orderkey % 50 = 49"""


def _documents(q: With, span: int) -> str:
    """Events by document."""
    q.add(
        "e",
        f"""SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS v,
        event_id // {span} AS chunk, event_id % {span} AS num, (event_id % {span}) // {span // 10} AS drive FROM events""",
    )
    return q.add("d", "SELECT *, user_id || '-' || chunk AS game_id FROM e")


def _document_plays(q: With, span: int) -> str:
    number = f"CASE WHEN k % 17 = 0 THEN 0 ELSE {span} - num END"
    return q.add(
        "doc_plays",
        f"""SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY {number}, event_id) AS ord,
        CAST(event_id AS VARCHAR) AS play_id, {number} AS sequence_number, 0 AS drive_group,
        CASE WHEN drive % 2 = 0 THEN 'H' ELSE 'A' END AS drive_team_id, CAST(k % 4 + 1 AS INTEGER) AS period,
        CASE WHEN k % 5 = 0 THEN '0:00' ELSE {O.clock('(v * 3)')} END AS clock, upper(event_type[1]) || substr(event_type, 2) AS play_type_text,
        5 AS play_type_id, event_type AS description, v AS home_score, k % 40 AS away_score, k % 4 AS start_down, k % 12 AS start_distance,
        CASE WHEN k % 4 <> 0 THEN k END AS yards_to_endzone, CASE WHEN k % 7 <> 0 THEN v % 25 ELSE 0 END AS stat_yardage, k % 2 = 0 AS scoring_play,
        k % 7 AS score_value, k % 3 AS end_down, CASE WHEN k % 9 = 0 THEN 'Kick good' END AS pat_text, CASE WHEN k % 9 = 0 THEN 1 END AS pat_value,
        CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS null_defaulted FROM {_documents(q, span)} WHERE k NOT IN (20, 30)""",
    )


_q = With()
SQL["json_plays"] = _q.select(f"SELECT * FROM {_document_plays(_q, 300)}")
_q = With()
_names = "'' AS wallclock, 'H' AS home_team_id, 'A' AS away_team_id, 'Texas Tech' AS home_name, 'App State' AS away_name, 'TTU' AS home_abbrev, 'APP' AS away_abbrev"
_found = O.pipeline(_q, _q.add("doc_feed", f"SELECT * EXCLUDE (drive_group, null_defaulted), {_names} FROM {_document_plays(_q, 30_000)}"))
SQL["json_entries"] = _q.select(f"SELECT game_id, 'cfb' AS league, {ENTRY}, play_index, qc_issue, gap_note, fix_note, is_placeholder FROM {_found}")
_q = With()
SQL["json_headers"] = _q.select(
    f"""SELECT DISTINCT game_id, 'cfb' AS league, CASE WHEN user_id % 5 = 0 THEN 'in' ELSE 'post' END AS status,
    'H' AS home_team_id, 'Texas Tech' AS home_name, 'TTU' AS home_abbrev, 'App State' AS away_name FROM {_documents(_q, 300)}"""
)

# -- pipelines

on_feed(
    "full_pipeline",
    f"SELECT game_id, {ENTRY}, play_index, qc_issue, gap_note, fix_note, is_placeholder FROM {{src}}",
    O.pipeline,
)
on_feed(
    "game_results",
    """SELECT game_id, arg_max(scored_home, play_index) AS actual_home, arg_max(scored_away, play_index) AS actual_away
    FROM {src} WHERE NOT is_placeholder GROUP BY game_id""",
    O.pipeline,
)


def _checked(mode: str, q: With | None = None, entries: str | None = None, games: str | None = None) -> With:
    """``final_entries``, ``resolved`` and ``games``: of the feed, or of other entries."""
    q = q or With()
    entries = entries or O.pipeline(q, O.feed(q))
    # The checker looks at the same rows again.
    q.add("final_entries", f"SELECT game_id, ord, play_index, qc_issue, home_name, away_name, {ENTRY} FROM {entries}")
    second = With()
    O.issues(second, "final_entries")
    for part in second.parts:
        name, body = part.split(" AS (", 1)
        for inner in ("delta_0", "delta_1", "deltas"):
            body = body.replace(inner, "c_" + inner)
            name = "c_" + inner if name == inner else name
        q.parts.append(f"{name} AS ({body}")
    O.resolved(q, "final_entries", mode)
    q.add("games", games or _GAMES[1:-1])
    return q


SQL["historical_qc"] = O.summary(_checked("historical"), "games", "final_entries")
SQL["historical_alerts"] = _checked("historical").select(
    """SELECT game_id, severity, type, message FROM resolved
    QUALIFY row_number() OVER (PARTITION BY game_id, type, message ORDER BY play_index, check_no) = 1
    UNION ALL SELECT game_id, 'OK', 'ok', 'No issues found — ' || count(*) || ' plays checked' FROM final_entries
    WHERE game_id NOT IN (SELECT game_id FROM resolved) GROUP BY game_id"""
)
on_feed(
    "published_results",
    """SELECT game_id, play_index, down, home_score, qc_issue FROM {src} WHERE game_id % 3 = 0 OR (game_id % 3 = 1 AND play_index % 2 = 0)""",
    O.pipeline,
)


def _failing() -> With:
    """Documents of which some are cut off, and some hold numbers that cannot be mapped."""
    q = With()
    _document_plays(q, 30_000)
    q.add("cut", "SELECT DISTINCT game_id FROM d WHERE user_id % 7 = 3")
    # Of a game's plays in the order of the document (its drives, then its last one again) the first with such a number.
    q.add(
        "wrong",
        """SELECT game_id, arg_min(CASE WHEN user_id % 12 = 5 THEN 'awayScore is 99999999999' ELSE 'scoreValue is five' END, event_id) AS reason FROM d
        WHERE k NOT IN (20, 30) AND game_id NOT IN (SELECT game_id FROM cut)
          AND ((user_id % 12 = 5 AND (k % 40) % 10 = 7) OR (user_id % 12 = 11 AND k % 7 = 5)) GROUP BY game_id""",
    )
    sound = f"SELECT * EXCLUDE (drive_group, null_defaulted), {_names} FROM doc_plays WHERE game_id NOT IN (SELECT game_id FROM cut UNION ALL SELECT game_id FROM wrong)"
    entries = O.pipeline(q, q.add("doc_feed", sound))
    return _checked("historical", q, entries, "SELECT DISTINCT game_id FROM d")


SQL["historical_failures_summary"] = O.summary(_failing(), "games", "final_entries")
SQL["historical_failures"] = _failing().select(
    """SELECT game_id, severity, type, message FROM resolved
    QUALIFY row_number() OVER (PARTITION BY game_id, type, message ORDER BY play_index, check_no) = 1
    UNION ALL SELECT g.game_id, 'OK', 'ok', 'No issues found — ' || count(f.game_id) || ' plays checked' FROM games g LEFT JOIN final_entries f USING (game_id)
    WHERE g.game_id NOT IN (SELECT game_id FROM resolved UNION ALL SELECT game_id FROM cut UNION ALL SELECT game_id FROM wrong) GROUP BY g.game_id
    UNION ALL SELECT game_id, 'ERROR', 'fetch_failed', 'Failed to fetch plays: unreadable document' FROM cut
    UNION ALL SELECT game_id, 'ERROR', 'fetch_failed', 'Failed to fetch plays: ' || reason FROM wrong"""
)
_live = _checked("live")
_live.parts += [_DAILY.removeprefix("WITH ")]
SQL["live_alerts"] = _live.select(
    f"""SELECT game_id, severity, type, message, {_KEY} AS alert_key FROM resolved WHERE game_id % 6 = 0
    QUALIFY row_number() OVER (PARTITION BY game_id, type, message ORDER BY play_index, check_no) = 1
    UNION SELECT game_id, severity, type, message, alert_key FROM stalls WHERE game_id % 6 = 0"""
)
on_feed("play_viewer", f"SELECT game_id, play_index + 1 AS play_no, {_LOG}, qc_issue, {_CLASSES} FROM {{src}}", O.pipeline)

# -- streaming

on_entries("stream_equals_batch", "SELECT game_id, ord, down, qc_issue FROM {src}", O.issue_text)
SQL["stream_alert_keys"] = """SELECT DISTINCT user_id AS game_id, event_type AS type, user_id || ':' || event_type AS alert_key FROM events"""
_q = With()
_found = O.pipeline(_q, _q.add("doc_feed", f"SELECT * EXCLUDE (drive_group, null_defaulted), {_names} FROM {_document_plays(_q, 30_000)}"))
SQL["stream_refresh"] = _q.select(
    f"""SELECT game_id, 'cfb' AS league, {ENTRY}, play_index, qc_issue, gap_note, fix_note, is_placeholder,
    CAST(CASE WHEN CAST(split_part(game_id, '-', 1) AS BIGINT) % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS version FROM {_found}"""
)
SQL["refresh_one_game"] = _q.select(
    f"""SELECT game_id, CAST(CASE WHEN live THEN 2 ELSE 1 END AS BIGINT) AS version, n AS play_count, CASE WHEN live THEN 'in' ELSE 'post' END AS status,
    CAST(CASE WHEN live AND n > 0 AND game_id <> min(CASE WHEN live THEN game_id END) OVER () THEN 1 ELSE 0 END AS BIGINT) AS stalled
    FROM (SELECT game_id, user_id % 5 = 0 AS live, coalesce(n, 0) AS n FROM (SELECT DISTINCT game_id, user_id FROM d)
      LEFT JOIN (SELECT game_id, count(*) AS n FROM {_found} GROUP BY game_id) USING (game_id))"""
)
SQL["stream_games"] = f"""WITH {_SCHEDULE},
o AS (SELECT o.*, {_POINTS}, s.league, s.season, s.week, CASE WHEN s.league = 'nfl' THEN 'now' ELSE 'old' END AS detail
  FROM orders o JOIN schedule s ON s.game_id = o_orderkey)
SELECT league, season, 2 AS seasontype, week, {_GAME}, CAST(CASE WHEN league = 'nfl' THEN 1 ELSE 0 END AS BIGINT) AS batch_id
FROM o WHERE key % 50 <> 49 AND key % 15 <> 7 AND (league <> 'nfl' OR key % 13 <> 0)"""
SQL["stream_alert_store"] = """SELECT user_id AS game_id, 'INFO' AS severity, event_type AS type, 'on ' || strftime(ts, '%Y-%m-%d') AS message,
user_id || ':' || event_type || ':on ' || strftime(ts, '%Y-%m-%d') AS alert_key, 1::BIGINT AS times FROM events GROUP BY ALL"""
