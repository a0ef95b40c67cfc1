"""DuckDB statements that state each query again, for comparison.

They are written independently of the Spark operators: recursive queries where those use closed forms,
correlated lookups where those use windows.
"""

from __future__ import annotations

NL = ",\n"

# Fixed values, written out again: a wrong one in the operators is to show here.
SECONDS = """
rush 7, pass reception 8, pass incompletion 5, passing touchdown 8, rushing touchdown 7, punt 10, field goal good 5, field goal missed 5,
blocked field goal 5, blocked punt 5, sack 7, penalty 6, fumble recovery 7, interception 7, pass interception return 7, kickoff 5,
kickoff return 5, timeout 0
"""
NOTES = {"live": "  [auto-fixed by pipeline — no red row]", "historical": "  [auto-fixed — no red row]"}
FEED_TEAMS = {"home_team_id": "H", "away_team_id": "A", "home_name": "Hawks", "away_name": "Wolves", "home_abbrev": "HWK", "away_abbrev": "WLV"}
CALLS = ("timeout HWK", "timeout WLV", "timeout Hawks", "timeout Wolves", "timeout home side", "timeout visitor", "timeout")


class With:
    """Collects common table expressions."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def add(self, name: str, body: str) -> str:
        self.parts.append(f"{name} AS ({body})")
        return name

    def select(self, statement: str) -> str:
        return f"WITH RECURSIVE {NL.join(self.parts)}\n{statement}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def seconds(clock: str) -> str:
    first, second = (f"TRY_CAST(split_part({clock}, ':', {i}) AS INTEGER)" for i in (1, 2))
    return f"CAST(CASE WHEN len(string_split({clock}, ':')) = 2 THEN coalesce({first} * 60 + {second}, 0) ELSE 0 END AS BIGINT)"


def clock(secs: str) -> str:
    return f"(CAST(greatest({secs}, 0) // 60 AS VARCHAR) || ':' || lpad(CAST(greatest({secs}, 0) % 60 AS VARCHAR), 2, '0'))"


def position(yards: str) -> str:
    return f"CAST(CASE WHEN {yards} IS NULL THEN 0 WHEN {yards} > 50 THEN {yards} - 100 WHEN {yards} < 50 THEN {yards} ELSE -50 END AS INTEGER)"


def has(column: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {text(n)})" for n in needles) + ")"


def duration(kind: str) -> str:
    rules = (rule.strip().rsplit(" ", 1) for rule in SECONDS.replace("\n", " ").split(","))
    cases = " ".join(f"WHEN contains(lower({kind}), {text(k)}) THEN {s}" for k, s in rules)
    return f"CAST(CASE {cases} ELSE 6 END AS INTEGER)"


# -- feeds ---------------------------------------------------------------------------------------


def base(q: With) -> str:
    q.add(
        "ev",
        """SELECT user_id AS game_id, ts, event_id, event_type AS kind,
        CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS v FROM events""",
    )
    q.add(
        "ev_n",
        """SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY ts, event_id) AS n,
        count(*) OVER (PARTITION BY game_id) AS cnt FROM ev""",
    )
    q.add(
        "ev_period",
        "SELECT *, CAST(1 + (n - 1) * 5 // cnt AS INTEGER) AS period FROM ev_n",
    )
    q.add(
        "ev_pn",
        """SELECT *, row_number() OVER (PARTITION BY game_id, period ORDER BY n) AS pn,
        count(*) OVER (PARTITION BY game_id, period) AS pc FROM ev_period""",
    )
    q.add(
        "ev_pts",
        """SELECT *, k % 2 = 0 AS is_home,
        greatest(0, 900 - 900 * (CASE WHEN game_id % 3 = 0 THEN pn - pn % 7 ELSE pn END) // (pc + 1)
                    + CASE WHEN k = 50 THEN 400 ELSE 0 END) AS secs,
        CASE WHEN kind = 'purchase' AND k = 15 THEN 0
             WHEN kind = 'purchase' AND k < 40 THEN (CASE k % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 7 END)
             WHEN kind = 'purchase' AND k < 55 THEN 3 WHEN kind = 'purchase' AND k < 70 THEN 7
             WHEN kind = 'purchase' THEN 1
             WHEN kind = 'error' AND k = 99 THEN -3 WHEN kind = 'error' AND k = 98 THEN 5
             WHEN pn = 1 AND n > 1 AND k < 30 THEN 7 WHEN pn = 2 AND k < 40 THEN 6
             WHEN kind = 'error' AND k BETWEEN 90 AND 95 THEN 6
             WHEN kind = 'click' AND k = 7 THEN -7 WHEN kind = 'click' AND k = 6 THEN -8 ELSE 0 END AS pts,
        CASE WHEN kind = 'purchase' AND k IN (25, 65) THEN 1 WHEN kind = 'purchase' AND k IN (35, 60) THEN 2
             ELSE 0 END AS late FROM ev_pn""",
    )
    # Points of a play are added to the score of the row they are credited on.
    q.add("credits", "SELECT game_id, n + late AS n, is_home, pts FROM ev_pts")
    q.add(
        "credited",
        """SELECT game_id, n, sum(CASE WHEN is_home THEN pts ELSE 0 END) AS h, sum(CASE WHEN is_home THEN 0 ELSE pts END) AS a
        FROM credits GROUP BY game_id, n""",
    )
    names = ", ".join(f"{text(v)} AS {c}" for c, v in FEED_TEAMS.items())
    return q.add(
        "base",
        f"""SELECT e.*, n AS ord, {clock('secs')} AS clock, CAST(v % 25 - 5 AS INTEGER) AS gain,
        CAST(CASE WHEN k % (CASE WHEN game_id % 4 = 0 THEN 20 ELSE 4 END) = 0 THEN NULL ELSE (k * 7 + n) % 101 END AS INTEGER)
            AS yards_to_endzone,
        CAST(sum(c.h) OVER w AS INTEGER) AS home_score, CAST(sum(c.a) OVER w AS INTEGER) AS away_score, {names}
        FROM ev_pts e LEFT JOIN credited c USING (game_id, n) WINDOW w AS (PARTITION BY game_id ORDER BY n)""",
    )


def feed(q: With) -> str:
    base(q)
    q.add(
        "typed",
        """SELECT *, CASE WHEN pn = 1 THEN 'Kickoff'
        WHEN kind = 'purchase' THEN (CASE WHEN k < 40 THEN 'Passing Touchdown' WHEN k < 55 THEN 'Field Goal Good'
                                          WHEN k < 70 THEN 'Punt Return Touchdown' ELSE 'Extra Point Good' END)
        WHEN kind = 'click' THEN (CASE WHEN k < 60 THEN 'Rush' WHEN k < 80 THEN 'Two Point Rush' ELSE 'Sack' END)
        WHEN kind = 'view' THEN (CASE WHEN k < 70 THEN 'Pass Reception' WHEN k < 90 THEN 'Pass Incompletion'
                                      ELSE 'Pass Interception Return' END)
        WHEN kind = 'signup' THEN (CASE WHEN k < 50 THEN 'Punt' WHEN k < 75 THEN 'Timeout' ELSE 'Kickoff Return (Offense)' END)
        ELSE (CASE WHEN k < 10 THEN 'End Period' WHEN k < 40 THEN 'Penalty' WHEN k < 60 THEN 'Fumble Recovery (Own)'
                   ELSE 'Rush' END) END AS play_type_text FROM base""",
    )
    calls = " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(CALLS))
    return q.add(
        "feed",
        f"""SELECT game_id, ord, CAST(event_id AS VARCHAR) AS play_id, ord AS sequence_number, period, clock, play_type_text,
        CASE WHEN play_type_text = 'Timeout' THEN 21 ELSE 5 END AS play_type_id,
        CASE WHEN play_type_text = 'Timeout' THEN (CASE k % 7 {calls} END) ELSE play_type_text END AS description,
        home_score, away_score, 1 + k % 4 AS start_down, k % 12 AS start_distance, yards_to_endzone, gain AS stat_yardage,
        (play_type_text LIKE '%Touchdown' OR play_type_text = 'Field Goal Good') AS scoring_play,
        CASE WHEN play_type_text LIKE '%Touchdown' THEN 6 WHEN play_type_text = 'Field Goal Good' THEN 3 ELSE 0 END AS score_value,
        CASE WHEN k % 13 = 0 THEN 'X' WHEN (n // 6) % 2 = 0 THEN 'H' ELSE 'A' END AS drive_team_id,
        CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE 1 + (k + n) % 4 END AS INTEGER) AS end_down,
        CASE WHEN play_type_text LIKE '%Touchdown' AND k % 5 = 0 THEN 'Extra Point Good' END AS pat_text,
        CASE WHEN play_type_text LIKE '%Touchdown' AND k % 5 = 0 THEN 1 END AS pat_value,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') AS wallclock, {', '.join(FEED_TEAMS)} FROM typed""",
    )


def entryfeed(q: With) -> str:
    base(q)
    moved = "(CASE WHEN kind = 'purchase' AND k % 10 = 0 THEN 2 ELSE 0 END)"
    return q.add(
        "entryfeed",
        f"""SELECT game_id, ord, home_score - {moved} AS home_score, away_score + {moved} AS away_score, clock,
        CASE WHEN period <= 4 THEN CAST(period AS VARCHAR) ELSE 'OT' END AS quarter,
        CASE WHEN pn = 1 THEN 'KO' WHEN kind = 'purchase' THEN (CASE WHEN k < 50 THEN 'EP' ELSE '2PT' END)
             WHEN kind = 'click' THEN '1' WHEN kind = 'view' THEN '2' WHEN kind = 'signup' THEN '3'
             ELSE (CASE WHEN k < 20 THEN 'KO' ELSE '4' END) END AS down,
        k % 12 AS distance, gain, {position('yards_to_endzone')} AS field_position,
        CASE WHEN is_home THEN home_name ELSE away_name END AS possession, 'No' AS run_clock, 'No' AS home_time_out,
        'No' AS away_time_out, kind AS play_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS wallclock, home_name, away_name
        FROM base""",
    )


# -- operators on plays --------------------------------------------------------------------------

G = "PARTITION BY game_id ORDER BY ord"


def infer(q: With, src: str) -> str:
    attempt = has("t", "extra point", "two-point", "two point", "pat")
    q.add(
        "pat_in",
        f"""SELECT *, greatest(home_score - lag(home_score, 1, 0) OVER w, away_score - lag(away_score, 1, 0) OVER w) AS rise,
        lead(play_type_text, 1, '') OVER w AS t1, lead(play_type_text, 2, '') OVER w AS t2 FROM {src} WINDOW w AS ({G})""",
    )
    miss = f"(score_value = 6 AND pat_value IS NULL AND NOT {attempt.replace('(t)', '(t1)')} AND NOT {attempt.replace('(t)', '(t2)')})"
    return q.add(
        "pats",
        f"""SELECT * REPLACE (
        CASE WHEN {miss} THEN (CASE rise WHEN 7 THEN 'Extra Point Good' WHEN 8 THEN 'Two-Point Conversion'
                                    WHEN 6 THEN 'Extra Point Attempt - No Good' END) ELSE pat_text END AS pat_text,
        CASE WHEN {miss} THEN (CASE rise WHEN 7 THEN 1 WHEN 8 THEN 2 WHEN 6 THEN 0 END) ELSE pat_value END AS pat_value)
        FROM pat_in""",
    )


def side(q: With, src: str) -> str:
    q.add(
        "side_in",
        f"""SELECT *, lag(home_score, 1, 0) OVER w AS ph, lag(away_score, 1, 0) OVER w AS pa,
        lead(home_score, 1) OVER w AS h1, lead(away_score, 1) OVER w AS a1,
        lead(home_score, 2) OVER w AS h2, lead(away_score, 2) OVER w AS a2 FROM {src} WINDOW w AS ({G})""",
    )
    steps = " ".join(
        f"WHEN {h} - ph >= 6 THEN 'home' WHEN {a} - pa >= 6 THEN 'away'"
        for h, a in (("home_score", "away_score"), ("h1", "a1"), ("h2", "a2"))
    )
    return q.add("sides", f"SELECT *, CASE WHEN pat_value IS NOT NULL THEN (CASE {steps} END) END AS td_scoring_team FROM side_in")


def period_runs(q: With, src: str, name: str) -> str:
    q.add(name + "_0", f"SELECT *, lag(period) OVER ({G}) IS DISTINCT FROM period AS starts FROM {src}")
    return q.add(name, f"SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER ({G}) AS run FROM {name}_0")


def stuck(q: With, src: str) -> str:
    period_runs(q, src, "runs")
    q.add("st_s", f"SELECT *, {seconds('clock')} AS secs, lag(clock) OVER (PARTITION BY game_id, run ORDER BY ord) IS DISTINCT FROM clock AS heads FROM runs")
    q.add("st_i", f"SELECT *, sum(CASE WHEN heads THEN 1 ELSE 0 END) OVER ({G}) AS island FROM st_s")
    q.add(
        "st_len",
        """SELECT game_id, island, min(run) AS run, min(ord) AS first_ord, max(ord) AS last_ord, min(secs) AS secs,
        count(*) AS len FROM st_i GROUP BY game_id, island HAVING count(*) >= 6""",
    )
    q.add(
        "st_end",
        """SELECT l.game_id, l.island, l.first_ord, l.len, l.secs AS start_secs, arg_min(r.secs, r.ord) AS end_secs
        FROM st_len l LEFT JOIN st_i r ON r.game_id = l.game_id AND r.run = l.run AND r.ord > l.last_ord AND r.secs < l.secs
        GROUP BY ALL""",
    )
    place = "(row_number() OVER (PARTITION BY game_id, island ORDER BY ord) - 1)"
    q.add("st_j", f"SELECT i.*, e.len, e.start_secs, e.end_secs, {place} AS idx FROM st_i i LEFT JOIN st_end e USING (game_id, island)")
    new = "CASE WHEN end_secs IS NULL THEN start_secs - 30 * idx ELSE CAST(trunc(start_secs - (CAST(start_secs - end_secs AS DOUBLE) / len) * idx) AS BIGINT) END"
    return q.add("unstuck", f"SELECT * EXCLUDE (clock), clock AS clock_before, CASE WHEN len IS NOT NULL AND idx > 0 THEN {clock('(' + new + ')')} ELSE clock END AS clock FROM st_j")


def monotone(q: With, src: str) -> str:
    period_runs(q, src, "mruns")
    q.add("mono_s", f"SELECT *, {seconds('clock')} AS csecs, count(*) OVER (PARTITION BY game_id) AS n_rows FROM mruns")
    q.add("mono_m", "SELECT *, least(900, min(csecs) OVER (PARTITION BY game_id, run ORDER BY ord)) AS low FROM mono_s")
    return q.add("monotone", f"SELECT * REPLACE (CASE WHEN n_rows >= 6 AND csecs > low THEN {clock('low')} ELSE clock END AS clock), clock AS clock_in FROM mono_m")


def snap(q: With, src: str) -> str:
    q.add(
        "snap_s",
        f"""SELECT *, {seconds('clock')} AS ssecs, lag({seconds('clock')}) OVER w AS psecs,
        lag(period) OVER w IS NOT DISTINCT FROM period AS same FROM {src} WINDOW w AS ({G})""",
    )
    value = f"least(ssecs + {duration('play_type_text')}, CASE WHEN same THEN psecs ELSE 900 END, 900)"
    return q.add("snaps", f"SELECT * REPLACE ({clock(value)} AS clock), clock AS clock_end FROM snap_s")


def flagged(q: With, src: str) -> str:
    t = "play_type_text"
    return q.add(
        "pflags",
        f"""SELECT *, ({has(t, 'kickoff')} AND NOT {has(t, 'return')}) AS is_kickoff,
        (lower({t}) = 'timeout' OR play_type_id = 21) AS is_timeout, {has(t, 'punt')} AS is_punt,
        {has(t, 'field goal')} AS is_field_goal, {has(t, 'extra point', 'pat')} AS is_extra_point,
        {has(t, 'two-point', 'two point', '2pt')} AS is_two_point,
        ({has(t, 'rush')} AND NOT ({has(t, 'kickoff')} AND NOT {has(t, 'return')})) AS is_rush,
        {has(t, 'pass', 'reception')} AS is_pass, {has(t, 'sack')} AS is_sack FROM {src}""",
    )


def situated(q: With, src: str) -> str:
    flagged(q, src)
    q.add(
        "sit_0",
        f"""SELECT *, CASE WHEN is_kickoff AND drive_team_id = home_team_id THEN away_name WHEN is_kickoff THEN home_name
             WHEN drive_team_id = away_team_id THEN away_name ELSE home_name END AS possession,
        CASE WHEN is_kickoff THEN 'KO' WHEN is_extra_point THEN 'EP' WHEN is_two_point THEN '2PT'
             WHEN coalesce(start_down, 0) = 0 THEN '1' ELSE CAST(start_down AS VARCHAR) END AS down,
        CASE WHEN is_kickoff THEN 0 WHEN is_extra_point OR is_two_point THEN 3
             WHEN coalesce(start_distance, 0) = 0 THEN 10 ELSE start_distance END AS distance,
        CASE WHEN is_kickoff OR is_extra_point OR is_two_point OR is_timeout THEN 0 ELSE stat_yardage END AS gain,
        CASE WHEN is_kickoff THEN -35 WHEN is_extra_point OR is_two_point THEN 3
             ELSE {position('yards_to_endzone')} END AS field_position FROM pflags""",
    )
    q.add(
        "sit_1",
        """SELECT *, CASE WHEN is_rush AND NOT scoring_play AND end_down IS DISTINCT FROM 1 AND gain < distance
                          THEN 'Yes' ELSE 'No' END AS run_clock,
        CASE WHEN NOT is_timeout THEN '' WHEN contains(lower(description), lower(home_abbrev)) THEN 'home'
             WHEN contains(lower(description), lower(away_abbrev)) THEN 'away'
             WHEN contains(lower(description), lower(home_name)) THEN 'home'
             WHEN contains(lower(description), lower(away_name)) THEN 'away'
             WHEN contains(lower(description), 'home') THEN 'home'
             WHEN contains(lower(description), 'away') OR contains(lower(description), 'visitor') THEN 'away'
             ELSE '' END AS tside FROM sit_0""",
    )
    return q.add(
        "situated",
        """SELECT *, CASE WHEN tside = 'home' THEN 'Yes' ELSE 'No' END AS home_time_out,
        CASE WHEN tside = 'away' THEN 'Yes' ELSE 'No' END AS away_time_out,
        CASE WHEN period <= 4 THEN CAST(period AS VARCHAR) ELSE 'OT' END AS quarter FROM sit_1""",
    )


ENTRY = (
    "home_score, away_score, clock, quarter, down, distance, gain, field_position, possession, run_clock, "
    "home_time_out, away_time_out, play_text, wallclock"
)


def split_pats(q: With, src: str) -> str:
    situated(q, src)
    q.add(
        "split_0",
        """SELECT *, pat_value IS NOT NULL AND NOT is_kickoff AND NOT is_field_goal AND NOT is_extra_point AND NOT is_two_point AS att,
        CASE WHEN td_scoring_team IS NOT NULL THEN td_scoring_team = 'home' WHEN is_punt THEN drive_team_id <> home_team_id
             ELSE drive_team_id = home_team_id END AS by_home FROM situated""",
    )
    two = has("pat_text", "two", "2pt", "2-point")
    return q.add(
        "entries",
        f"""SELECT game_id, ord * 2 AS ord, home_name, away_name,
        CAST(home_score - CASE WHEN att AND pat_value > 0 AND by_home THEN pat_value ELSE 0 END AS INTEGER) AS home_score,
        CAST(away_score - CASE WHEN att AND pat_value > 0 AND NOT by_home THEN pat_value ELSE 0 END AS INTEGER) AS away_score,
        clock, quarter, down, distance, gain, field_position, possession, run_clock, home_time_out, away_time_out,
        description AS play_text, wallclock FROM split_0
        UNION ALL
        SELECT game_id, ord * 2 + 1, home_name, away_name, home_score, away_score, clock, quarter,
        CASE WHEN {two} OR pat_value = 2 THEN '2PT' ELSE 'EP' END, 3, 0, 3, possession, 'No', 'No', 'No', pat_text, wallclock
        FROM split_0 WHERE att""",
    )


# -- operators on entries ------------------------------------------------------------------------


def fill(q: With, src: str) -> str:
    """Row by row, as a recursive query."""
    q.add("fill_n", f"SELECT *, row_number() OVER ({G}) AS fn FROM {src}")
    prev = "(CASE WHEN f.fp < 0 THEN 100 + f.fp ELSE f.fp END - f.gain)"
    new = position(f"greatest(0, least(100, {prev}))")
    q.add(
        "fill_r",
        f"""SELECT game_id, fn, field_position AS fp, gain FROM fill_n WHERE fn = 1
        UNION ALL
        SELECT e.game_id, e.fn, CASE WHEN e.field_position = 0 AND f.fp <> 0 THEN {new} ELSE e.field_position END, e.gain
        FROM fill_r f JOIN fill_n e ON e.game_id = f.game_id AND e.fn = f.fn + 1""",
    )
    return q.add(
        "filled",
        "SELECT n.* EXCLUDE (fn, field_position), n.field_position AS position_before, r.fp AS field_position "
        "FROM fill_n n JOIN fill_r r USING (game_id, fn)",
    )


def lagged(q: With, src: str) -> str:
    return q.add(
        "lagged",
        f"""SELECT * EXCLUDE (home_score, away_score), home_score AS scored_home, away_score AS scored_away,
        lag(home_score, 1, 0) OVER w AS home_score, lag(away_score, 1, 0) OVER w AS away_score FROM {src} WINDOW w AS ({G})""",
    )


def autofix(q: With, src: str) -> str:
    q.add("fix_n", f"SELECT *, row_number() OVER ({G}) AS xn FROM {src}")
    home = "(e.down IN ('EP', '2PT') AND e.home_score < f.h AND e.away_score >= f.a)"
    away = "(e.down IN ('EP', '2PT') AND e.away_score < f.a AND e.home_score >= f.h)"
    q.add(
        "fix_r",
        f"""SELECT game_id, xn, home_score AS h, away_score AS a, '' AS fix_note FROM fix_n WHERE xn = 1
        UNION ALL
        SELECT e.game_id, e.xn,
        CASE WHEN {home} THEN f.h WHEN {away} THEN e.home_score - (f.a - e.away_score) ELSE e.home_score END,
        CASE WHEN {home} THEN e.away_score - (f.h - e.home_score) WHEN {away} THEN f.a ELSE e.away_score END,
        CASE WHEN {home} THEN 'Auto-fixed: EP credited to wrong team (home restored +' || (f.h - e.home_score) || ')'
             WHEN {away} THEN 'Auto-fixed: EP credited to wrong team (away restored +' || (f.a - e.away_score) || ')'
             ELSE '' END
        FROM fix_r f JOIN fix_n e ON e.game_id = f.game_id AND e.xn = f.xn + 1""",
    )
    return q.add(
        "fixed",
        "SELECT n.* EXCLUDE (xn, home_score, away_score), r.h AS home_score, r.a AS away_score, r.fix_note "
        "FROM fix_n n JOIN fix_r r USING (game_id, xn)",
    )


def gaps(q: With, src: str, fix_note: bool = False) -> str:
    """``fix_note``: the source has been through the auto-fix and the lag."""
    q.add(
        "gap_0",
        f"""SELECT *, lag(quarter) OVER w AS pq, lead(home_score) OVER w - home_score AS dh,
        lead(away_score) OVER w - away_score AS da FROM {src} WINDOW w AS ({G})""",
    )
    rises = (
        "CASE WHEN dh > 0 THEN home_name || ' +' || dh ELSE '' END || CASE WHEN dh > 0 AND da > 0 THEN ', ' ELSE '' END"
        " || CASE WHEN da > 0 THEN away_name || ' +' || da ELSE '' END"
    )
    extra = ", fix_note, scored_home, scored_away" if fix_note else ""
    none = ", '', NULL, NULL" if fix_note else ""
    return q.add(
        "gapped",
        f"""SELECT game_id, ord * 2 + 1 AS ord, home_name, away_name, {ENTRY}, FALSE AS is_placeholder, '' AS gap_note{extra} FROM gap_0
        UNION ALL
        SELECT game_id, ord * 2, home_name, away_name, home_score, away_score, '0:00', pq, '?', 0, 0, 0, '', 'No', 'No', 'No',
        'Score gap at period boundary (' || {rises} || ') — enter missing play(s) manually', '', TRUE,
        'Manual entry required — scoring play(s) missing from feed'{none}
        FROM gap_0 WHERE down = 'KO' AND pq IS NOT NULL AND pq <> quarter AND (dh > 0 OR da > 0)""",
    )


def indexed(q: With, src: str) -> str:
    return q.add("indexed", f"SELECT *, row_number() OVER ({G}) - 1 AS play_index FROM {src}")


def deltas(q: With, src: str) -> str:
    """Everything both checkers look at, per row."""
    q.add(
        "delta_0",
        f"""SELECT *, home_score - lag(home_score) OVER w AS hd, away_score - lag(away_score) OVER w AS ad,
        lag(down) OVER w AS pdown, lead(down, 1, '') OVER w AS ndown, lag(quarter) OVER w AS q1, lag(quarter, 2) OVER w AS q2,
        coalesce(lag(clock) OVER w = clock AND lag(quarter) OVER w = quarter AND down NOT IN ('KO', 'EP', '2PT'), FALSE) AS goes_on
        FROM {src} WINDOW w AS ({G})""",
    )
    q.add("delta_1", f"SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER ({G}) AS streak FROM delta_0")
    return q.add(
        "deltas",
        """SELECT *, row_number() OVER (PARTITION BY game_id, streak ORDER BY ord) AS stuck_row,
        coalesce((hd = 6 OR ad = 6) AND down NOT IN ('EP', '2PT') AND ndown NOT IN ('EP', '2PT'), FALSE) AS bare FROM delta_1""",
    )


def wide_flags(q: With, src: str) -> str:
    deltas(q, src)

    def score(d: str) -> str:
        return (
            f"CASE WHEN {d} IS NULL OR {d} IN (0, 1, 2, 3, 6, 7, 8, -7, -8) THEN NULL "
            f"WHEN {d} < 0 THEN 'Score dropped ' || {d} ELSE 'Score jumped +' || {d} END"
        )

    opening = "coalesce(pdown = 'KO' AND q1 <> q2, FALSE)"
    return q.add(
        "wide",
        f"""SELECT *, {score('hd')} AS home_score_flag, {score('ad')} AS away_score_flag,
        CASE WHEN stuck_row = 4 THEN 'Clock stuck (4+ plays)' END AS stuck_flag,
        CASE WHEN bare AND down <> 'KO' AND NOT {opening} THEN 'Missing EP after TD' END AS conversion_flag,
        CASE WHEN lead(bare AND down = 'KO') OVER ({G}) THEN 'Missing EP after TD' END AS earlier_conversion_flag FROM deltas""",
    )


def issue_text(q: With, src: str) -> str:
    wide_flags(q, src)
    flags = "home_score_flag, away_score_flag, stuck_flag, conversion_flag, earlier_conversion_flag"
    return q.add("noted", f"SELECT *, concat_ws(' · ', {flags}) AS qc_issue FROM wide")


def issues(q: With, src: str) -> str:
    """Long form; ``src`` has ``play_index``."""
    deltas(q, src)

    def score(team: str, d: str, check: int) -> str:
        at = "' at play #' || (play_index + 1)"
        return f"""SELECT game_id, CASE WHEN {d} IN (-7, -8) THEN 'INFO' WHEN {d} < 0 THEN 'ERROR' ELSE 'WARNING' END AS severity,
        CASE WHEN {d} IN (-7, -8) THEN 'bundled_score_artifact' WHEN {d} < 0 THEN 'score_regression' ELSE 'invalid_score_jump' END AS type,
        CASE WHEN {d} IN (-7, -8) THEN {team} || ' bundled-score lag artifact (' || {d} || ')' || {at}
             WHEN {d} < 0 THEN {team} || ' score decreased by ' || abs({d}) || {at}
             ELSE {team} || ' score jumped by ' || {d} || {at} || ' (unexpected value)' END AS message,
        play_index, {check} AS check_no FROM deltas WHERE {d} NOT IN (0, 1, 2, 3, 6, 7, 8)"""

    where = "(play_index - CASE WHEN down = 'KO' THEN 1 ELSE 0 END)"
    return q.add(
        "issues",
        f"""SELECT game_id, 'WARNING' AS severity, 'stuck_clock' AS type,
        'Clock stuck at ' || clock || ' for 4+ plays in Q' || quarter AS message, play_index, 1 AS check_no FROM deltas WHERE stuck_row = 4
        UNION ALL {score('home_name', 'hd', 2)} UNION ALL {score('away_name', 'ad', 3)}
        UNION ALL SELECT game_id, 'WARNING', 'missing_ep', 'TD by ' || CASE WHEN hd = 6 THEN home_name ELSE away_name END
            || ' at play #' || ({where} + 1) || ' — no EP or 2PT row follows', {where}, 4 FROM deltas WHERE bare
        UNION ALL SELECT game_id, 'INFO', 'missing_fp', count(*) || ' scrimmage plays have field_position=0 (missing data)', 0, 5
            FROM deltas WHERE field_position = 0 AND down IN ('1', '2', '3', '4') GROUP BY game_id HAVING count(*) > 3""",
    )


def resolved(q: With, qc: str, mode: str) -> str:
    """``qc``: table of ``game_id, play_index, qc_issue``."""
    fixed = "(type NOT IN ('score_regression', 'invalid_score_jump', 'missing_ep', 'bundled_score_artifact') AND coalesce(qc_issue = '', FALSE) AND severity IN ('ERROR', 'WARNING'))"
    return q.add(
        "resolved",
        f"""SELECT i.game_id, type, i.play_index, check_no, qc_issue AS entry_qc, {fixed} AS auto_fixed, severity AS original_severity,
        CASE WHEN {fixed} THEN 'INFO' ELSE severity END AS severity,
        CASE WHEN {fixed} THEN message || {text(NOTES[mode])} ELSE message END AS message
        FROM issues i LEFT JOIN {qc} e ON e.game_id = i.game_id AND e.play_index = i.play_index""",
    )


def pipeline(q: With, src: str = "feed") -> str:
    """The whole pipeline from plays to flagged entries."""
    side(q, infer(q, src))
    stuck(q, "sides")
    q.add("p_unstuck", "SELECT * EXCLUDE (run, starts, heads, island, secs, len, start_secs, end_secs, idx, clock_before) FROM unstuck")
    monotone(q, "p_unstuck")
    snap(q, "monotone")
    split_pats(q, "snaps")
    fill(q, "entries")
    lagged(q, "filled")
    autofix(q, "lagged")
    gaps(q, "fixed", fix_note=True)
    indexed(q, "gapped")
    issue_text(q, "indexed")
    return "noted"


def summary(q: With, games: str, entries: str) -> str:
    """One row from ``resolved``, a table of games and one of entries."""
    q.add("bad", "SELECT * FROM resolved WHERE severity IN ('ERROR', 'WARNING')")
    q.add(
        "sums",
        f"""SELECT (SELECT count(*) FROM {games}) AS total_games, (SELECT count(*) FROM {entries}) AS total_plays,
        (SELECT count(*) FROM resolved) AS issues_found, (SELECT count(DISTINCT game_id) FROM bad) AS games_with_issues,
        (SELECT count(DISTINCT game_id) FROM bad WHERE type IN ('score_regression', 'invalid_score_jump')) AS games_with_score,
        (SELECT count(DISTINCT game_id) FROM bad WHERE type = 'stuck_clock') AS games_with_clock,
        (SELECT count(DISTINCT game_id) FROM bad WHERE type = 'missing_ep') AS games_with_ep,
        (SELECT count(*) FROM (SELECT DISTINCT game_id, play_index FROM bad WHERE play_index >= 0)) AS flagged_plays""",
    )
    q.add("pct", "SELECT *, CASE WHEN total_plays > 0 THEN flagged_plays / total_plays * 100 ELSE 0.0 END AS pct_flagged FROM sums")

    def games_text(c: str) -> str:
        return f"CASE WHEN {c} = 0 THEN 'none' WHEN {c} = 1 THEN '1 game' ELSE {c} || ' games' END"

    return q.select(
        f"""SELECT *, CASE WHEN games_with_issues = 0 THEN 'green' WHEN games_with_issues / greatest(total_games, 1) > 0.3 THEN 'red'
             ELSE 'orange' END AS games_band,
        CASE WHEN pct_flagged < 2 THEN 'green' WHEN pct_flagged < 5 THEN 'orange' ELSE 'red' END AS plays_band,
        CASE WHEN games_with_issues = 0 THEN '✓  All ' || total_games || ' games are clean'
             ELSE games_with_issues || ' of ' || total_games || ' games have issues' END AS games_text,
        {games_text('games_with_score')} AS score_text, {games_text('games_with_clock')} AS clock_text,
        {games_text('games_with_ep')} AS ep_text,
        format('{{:,}}', total_plays) || ' plays scanned · ' || printf('%.1f', pct_flagged) || '% flagged' AS plays_text,
        'Done — ' || total_games || ' games, ' || issues_found || ' issue(s) found' AS done_text FROM pct"""
    )
