"""Plays rendered from the `events` table: structured columns and the sentence that tells the same story.

The projection uses integers, CASE and concatenation only, so Spark and DuckDB give the same rows for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.plans.shared import stash

_RENDERED: dict[tuple[str, str], DataFrame] = {}


def _pick(index: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {cases} END"


def _spot(at: str) -> str:
    return f"CASE WHEN {at} = 50 THEN '50' WHEN {at} < 50 THEN posteam || ' ' || CAST({at} AS STRING) ELSE defteam || ' ' || CAST(100 - ({at}) AS STRING) END"


def _gain(y: str) -> str:
    return f"CASE WHEN {y} = 0 THEN 'for no gain' ELSE 'for ' || CAST({y} AS STRING) || ' yards' END"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


_TEAMS, _PASSERS = ["GRN", "BAY", "OX", "RIO"], ["V.Marlow", "H.Tarrant", "O.Linden", "N.Castor"]
_RECEIVERS, _RUSHERS = ["E.Quill", "L.St. Orme", "R. Pell", "S.Dorn", "G.Whitlow"], ["K.Bray", "M.Osgood Jr.", "Y.Trent"]
_DEFENDERS = ["C.Hale", "J.Strand", "D.Voss"]

_BASE = f"""
    SELECT event_id, user_id, ts, value AS amount,
        (event_id * 7 + user_id * 13) % 100 AS k,
        CAST((event_id * 31 + user_id * 17) % 31 - 6 AS INT) AS y,
        CAST((event_id * 5 + user_id * 3) % 9 AS INT) AS z,
        CAST(25 + (event_id * 11 + user_id * 5) % 41 AS INT) AS los_at,
        {_pick("user_id", _TEAMS)} AS posteam, {_pick("user_id + 1", _TEAMS)} AS defteam,
        {_pick("user_id", _PASSERS)} AS passer, {_pick("event_id", _RECEIVERS)} AS receiver,
        {_pick("event_id + 1", _RECEIVERS)} AS taker, {_pick("event_id", _RUSHERS)} AS rusher, {_pick("event_id + user_id", _DEFENDERS)} AS defender
    FROM {{events}}
"""

_SHAPED = f"""
    SELECT b.*, 'G' || CAST(user_id AS STRING) AS game_id, event_id AS play_id,
        CAST(2015 + user_id % 10 AS INT) AS season, CAST(1 + user_id % 17 AS INT) AS week,
        CASE WHEN user_id % 17 < 15 THEN 'REG' ELSE 'POST' END AS season_type,
        CASE WHEN k < 30 THEN 'pass' WHEN k < 35 THEN 'pass_td' WHEN k < 55 THEN 'run' WHEN k < 58 THEN 'run_td' WHEN k < 63 THEN 'incomplete'
            WHEN k < 66 THEN 'sack' WHEN k < 69 THEN 'interception' WHEN k < 72 THEN 'fumble_lost' WHEN k < 74 THEN 'fumble_kept'
            WHEN k < 76 THEN 'no_play' WHEN k < 78 THEN 'timeout' WHEN k < 81 THEN 'penalty_stands' WHEN k < 83 THEN 'two_pass'
            WHEN k < 84 THEN 'two_run_fails' WHEN k < 85 THEN 'two_dead_ball' WHEN k < 87 THEN 'reversed' WHEN k < 89 THEN 'lateral'
            WHEN k < 90 THEN 'kneel' WHEN k < 91 THEN 'kickoff' WHEN k < 92 THEN 'punt' WHEN k < 93 THEN 'blank' WHEN k < 94 THEN 'nameless'
            WHEN k < 95 THEN 'timeout_penalty' WHEN k < 96 THEN 'sack_fumble' WHEN k < 97 THEN 'challenged' WHEN k < 98 THEN 'fumble_twice'
            WHEN k < 99 THEN 'declined' ELSE 'spike' END AS shape
    FROM base b
"""

_RECEIVER_TEXT = "CASE WHEN receiver = 'R. Pell' THEN 'R.Pell' ELSE receiver END"
_LATERAL_TEXT = "CASE WHEN taker = 'R. Pell' THEN 'R.Pell' ELSE taker END"
_CLOCK = "'(' || CAST(1 + user_id % 14 AS STRING) || ':' || CAST(10 + event_id % 49 AS STRING) || ') '"
_DEPTH = _pick("event_id + 2", ["short left", "deep middle", "short middle", "deep right"])
_WAY = _pick("event_id + 3", ["up the middle", "left end", "right guard"])
_THROWS = f"'14-' || passer || ' pass ' || {_DEPTH}"
_TO = f"' to 86-' || {_RECEIVER_TEXT}"
_CATCH = f"{_THROWS} || {_TO} || ' to ' || end_spot || ' ' || {_gain('y')} || ' (40-' || defender || ').'"
_RUN = f"'31-' || rusher || ' ' || {_WAY} || ' to ' || end_spot || ' ' || {_gain('y')} || ' (97-' || defender || ').'"
_ALL_THE_WAY = "' for ' || CAST(100 - los_at AS STRING) || ' yards, TOUCHDOWN.'"
_TRY = "'TWO-POINT CONVERSION ATTEMPT. '"

_PLAYS = f"""
    SELECT event_id, user_id, ts, amount, shape, game_id, play_id, season, week, season_type, posteam, defteam, z, los_at, end_at,
        los AS yrdln, CAST(100 - los_at AS DOUBLE) AS yardline_100,
        CASE WHEN shape IN ('pass', 'pass_td', 'incomplete', 'sack', 'interception', 'penalty_stands', 'reversed', 'lateral', 'nameless', 'sack_fumble') THEN 'pass'
            WHEN shape IN ('run', 'run_td', 'fumble_lost', 'fumble_kept', 'challenged', 'fumble_twice', 'declined') THEN 'run'
            WHEN shape IN ('no_play', 'timeout', 'two_dead_ball', 'timeout_penalty') THEN 'no_play' WHEN shape = 'two_pass' THEN 'pass'
            WHEN shape = 'two_run_fails' THEN 'run' WHEN shape = 'kneel' THEN 'qb_kneel' WHEN shape = 'spike' THEN 'qb_spike'
            WHEN shape = 'blank' THEN NULL ELSE shape END AS play_type,
        {_flag("shape IN ('no_play', 'penalty_stands', 'two_dead_ball')")} AS penalty,
        {_flag("shape IN ('reversed', 'challenged')")} AS replay_or_challenge,
        {_flag("shape IN ('pass', 'pass_td', 'penalty_stands', 'reversed', 'lateral', 'nameless')")} AS complete_pass,
        {_flag("shape = 'interception'")} AS interception,
        {_flag("shape IN ('pass_td', 'run_td')")} AS touchdown, {_flag("shape = 'pass_td'")} AS pass_touchdown, {_flag("shape = 'run_td'")} AS rush_touchdown,
        {_flag("shape IN ('two_pass', 'two_run_fails', 'two_dead_ball')")} AS two_point_attempt,
        CASE WHEN shape IN ('two_pass', 'two_dead_ball') THEN 'success' WHEN shape = 'two_run_fails' THEN 'failure' END AS two_point_conv_result,
        {_flag("shape IN ('fumble_lost', 'fumble_kept', 'sack_fumble', 'fumble_twice')")} AS fumble,
        {_flag("shape IN ('fumble_lost', 'sack_fumble', 'fumble_twice')")} AS fumble_lost,
        {_flag("shape = 'lateral'")} AS lateral_reception, CAST(NULL AS DOUBLE) AS lateral_rush,
        CASE WHEN shape IN ('pass', 'pass_td', 'incomplete', 'sack', 'interception', 'penalty_stands', 'reversed', 'lateral', 'nameless', 'sack_fumble', 'two_pass', 'two_dead_ball') THEN passer END AS passer_player_name,
        CASE WHEN shape IN ('pass', 'pass_td', 'penalty_stands', 'reversed', 'lateral', 'two_pass', 'two_dead_ball', 'incomplete') THEN receiver WHEN shape = 'nameless' THEN ' ' END AS receiver_player_name,
        CASE WHEN shape IN ('run', 'run_td', 'fumble_lost', 'fumble_kept', 'challenged', 'fumble_twice', 'declined', 'two_run_fails', 'no_play') THEN rusher WHEN shape = 'kneel' THEN passer END AS rusher_player_name,
        CASE WHEN shape = 'lateral' THEN taker END AS lateral_receiver_player_name, CAST(NULL AS STRING) AS lateral_rusher_player_name,
        CASE shape WHEN 'pass_td' THEN receiver WHEN 'run_td' THEN rusher END AS td_player_name,
        CASE WHEN shape IN ('pass', 'penalty_stands', 'reversed', 'nameless') THEN CAST(y AS DOUBLE) WHEN shape = 'pass_td' THEN CAST(100 - los_at AS DOUBLE) WHEN shape = 'lateral' THEN CAST(y + z AS DOUBLE) END AS passing_yards,
        CASE WHEN shape IN ('pass', 'penalty_stands', 'reversed', 'nameless', 'lateral') THEN CAST(y AS DOUBLE) WHEN shape = 'pass_td' THEN CAST(100 - los_at AS DOUBLE) END AS receiving_yards,
        CASE WHEN shape IN ('run', 'fumble_lost', 'fumble_kept', 'challenged', 'fumble_twice', 'declined', 'no_play') THEN CAST(y AS DOUBLE) WHEN shape = 'run_td' THEN CAST(100 - los_at AS DOUBLE) WHEN shape = 'kneel' THEN CAST(-1 AS DOUBLE) END AS rushing_yards,
        CASE WHEN shape = 'lateral' THEN CAST(z AS DOUBLE) END AS lateral_receiving_yards, CAST(NULL AS DOUBLE) AS lateral_rushing_yards,
        CASE WHEN shape IN ('fumble_lost', 'fumble_kept', 'fumble_twice') THEN rusher WHEN shape = 'sack_fumble' THEN passer END AS fumbled_1_player_name,
        CASE WHEN shape IN ('fumble_lost', 'fumble_kept', 'fumble_twice', 'sack_fumble') THEN posteam END AS fumbled_1_team,
        CASE shape WHEN 'fumble_lost' THEN defteam WHEN 'fumble_kept' THEN posteam WHEN 'fumble_twice' THEN posteam WHEN 'sack_fumble' THEN (CASE WHEN z < 3 THEN NULL ELSE defteam END) END AS fumble_recovery_1_team,
        CAST(NULL AS STRING) AS fumbled_2_player_name, CAST(NULL AS STRING) AS fumbled_2_team,
        CASE shape WHEN 'fumble_twice' THEN defteam END AS fumble_recovery_2_team,
        CASE WHEN shape = 'pass' THEN {_CLOCK} || {_CATCH}
            WHEN shape = 'pass_td' THEN {_CLOCK} || {_THROWS} || {_TO} || {_ALL_THE_WAY}
            WHEN shape IN ('run', 'challenged') THEN {_CLOCK} || {_RUN}
            WHEN shape = 'run_td' THEN {_CLOCK} || '31-' || rusher || ' ' || {_WAY} || {_ALL_THE_WAY}
            WHEN shape = 'incomplete' THEN '14-' || passer || ' pass incomplete ' || {_DEPTH} || {_TO} || ' (40-' || defender || ').'
            WHEN shape = 'sack' THEN {_CLOCK} || '14-' || passer || ' sacked at ' || los || ' for no gain (92-' || defender || ').'
            WHEN shape = 'interception' THEN {_CLOCK} || {_THROWS} || ' intended for 86-' || {_RECEIVER_TEXT} || ' INTERCEPTED by 28-' || defender || ' at ' || end_spot || '. 28-' || defender || ' runs out of bounds.'
            WHEN shape = 'fumble_lost' THEN {_CLOCK} || {_RUN} || ' FUMBLES (97-' || defender || '), RECOVERED by ' || defteam || '-28-' || defender || ' at ' || end_spot || '.'
            WHEN shape = 'fumble_kept' THEN {_RUN} || ' FUMBLES, recovered by ' || posteam || '-63-W.Petty at ' || end_spot || '.'
            WHEN shape = 'no_play' THEN {_CLOCK} || {_RUN} || ' PENALTY on ' || posteam || '-63-W.Petty, Illegal Motion, 5 yards, enforced at ' || los || ' - No Play.'
            WHEN shape = 'timeout' THEN 'Timeout #3 by ' || posteam || ' at 11:24.'
            WHEN shape = 'penalty_stands' THEN {_CATCH} || ' PENALTY on ' || defteam || '-40-' || defender || ', Roughing the Passer, 15 yards, enforced at ' || end_spot || '.'
            WHEN shape = 'two_pass' THEN {_TRY} || '14-' || passer || ' pass' || {_TO} || ' is good. ATTEMPT SUCCEEDS.'
            WHEN shape = 'two_run_fails' THEN {_TRY} || '31-' || rusher || ' rushes ' || {_WAY} || ', stopped short. ATTEMPT FAILS.'
            WHEN shape = 'two_dead_ball' THEN {_TRY} || '14-' || passer || ' pass' || {_TO} || ' is good. ATTEMPT SUCCEEDS. PENALTY on ' || defteam || ', Unsportsmanlike Conduct, 15 yards, enforced on the kick.'
            WHEN shape = 'reversed' THEN {_CLOCK} || '14-' || passer || ' pass incomplete ' || {_DEPTH} || {_TO} || '. A review was asked for, and the play was REVERSED. ' || {_CATCH}
            WHEN shape = 'lateral' THEN {_CLOCK} || {_CATCH} || ' Lateral to 17-' || {_LATERAL_TEXT} || ' to ' || lateral_spot || ' ' || {_gain('z')} || '.'
            WHEN shape = 'kneel' THEN '14-' || passer || ' kneels to ' || los || ' for -1 yards.'
            WHEN shape = 'kickoff' THEN '3-F.Crane kicks 60 yards from ' || posteam || ' 40 to the goal line.'
            WHEN shape = 'punt' THEN '9-P.Ostler punts 38 yards to ' || defteam || ' 17, downed.'
            WHEN shape = 'nameless' THEN {_CLOCK} || {_THROWS} || ' is caught at ' || end_spot || ' ' || {_gain('y')} || '.'
            WHEN shape = 'timeout_penalty' THEN 'Timeout #1 by ' || defteam || ' at 03:41. Penalty on ' || defteam || ', Neutral Zone Infraction, declined.'
            WHEN shape = 'sack_fumble' THEN {_CLOCK} || '14-' || passer || ' sacked at ' || los || ' for no gain (91-' || defender || '). FUMBLES (91-' || defender || ')' || CASE WHEN z < 3 THEN ', ball out of bounds in End Zone, Touchback.' ELSE ', RECOVERED by ' || defteam || '-96-' || defender || ' at ' || los || '.' END
            WHEN shape = 'fumble_twice' THEN {_RUN} || ' FUMBLES (97-' || defender || '), and recovers at ' || end_spot || '. 31-' || rusher || ' to ' || end_spot || ' for no gain. FUMBLES, RECOVERED by ' || defteam || '-97-' || defender || ' at ' || end_spot || '.'
            WHEN shape = 'declined' THEN {_CLOCK} || {_RUN} || ' Penalty on ' || defteam || ', Encroachment, declined.'
            WHEN shape = 'spike' THEN {_CLOCK} || '14-' || passer || ' spiked the ball at once.' END AS descr
    FROM (SELECT s.*, los_at + y AS end_at, {_spot("los_at")} AS los, {_spot("(los_at + y)")} AS end_spot, {_spot("(los_at + y + z)")} AS lateral_spot FROM shaped s) p
"""


def plays_sql(events: str = "events") -> str:
    """A WITH list (base, shaped, plays) over a table of events."""
    return f"base AS ({_BASE.format(events=events)}), shaped AS ({_SHAPED}), plays AS ({_PLAYS})"


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plays of `events`, rendered once for each application and directory; queries then read the columns they use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RENDERED:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        _RENDERED[key] = stash(spark.sql(f"WITH {plays_sql('{e}')} SELECT * FROM plays", e=events), "plays")
    return _RENDERED[key].select("*")


#: Totals from an independent source: raw columns by player, kneels included, some players off by a known amount.
_STAT_SOURCES = [
    ("pass_yds", "passer_player_name", "passing_yards", "two_point_attempt = 0"),
    ("rec_yds", "receiver_player_name", "receiving_yards", "two_point_attempt = 0"),
    ("rush_yds", "rusher_player_name", "rushing_yards", "two_point_attempt = 0"),
    ("rec_yds", "lateral_receiver_player_name", "lateral_receiving_yards", "lateral_reception = 1"),
    ("rec", "receiver_player_name", "1", "complete_pass = 1"),
    ("int", "passer_player_name", "1", "interception = 1"),
    ("pass_td", "passer_player_name", "1", "pass_touchdown = 1"),
    ("rec_td", "td_player_name", "1", "pass_touchdown = 1"),
    ("rush_td", "td_player_name", "1", "rush_touchdown = 1"),
    ("fumble_lost", "fumbled_1_player_name", "1", "fumble_lost = 1 AND NOT (shape = 'sack_fumble' AND fumble_recovery_1_team IS NULL)"),
    ("fumble_lost_total", "fumbled_1_player_name", "1", "fumble_lost = 1"),
    ("two_pt", "passer_player_name", "1", "two_point_conv_result = 'success'"),
    ("two_pt", "receiver_player_name", "1", "two_point_conv_result = 'success'"),
]


def official_sql() -> str:
    """A WITH item `official` over `plays`: game_id, team, player, the statistics, fumble_lost_total."""
    parts = " UNION ALL ".join(
        f"SELECT game_id, posteam AS team, {name} AS player, '{stat}' AS stat, CAST({value} AS BIGINT) AS value FROM plays "
        f"WHERE {where} AND {name} IS NOT NULL AND trim({name}) <> '' AND (play_type IN ('pass', 'run', 'qb_kneel') OR two_point_attempt = 1)"
        for stat, name, value, where in _STAT_SOURCES
    )
    stats = ["pass_yds", "pass_td", "int", "rush_yds", "rush_td", "rec", "rec_yds", "rec_td", "fumble_lost", "two_pt", "fumble_lost_total"]
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN stat = '{s}' THEN value END), 0){' + CASE WHEN length(player) % 4 = 1 AND length(game_id) = 3 THEN 1 ELSE 0 END' if s == 'rec_yds' else ''} AS BIGINT) AS {s}" for s in stats)
    return f"official_parts AS ({parts}), official AS (SELECT game_id, team, CASE WHEN player = 'R. Pell' THEN 'R.Pell' ELSE player END AS player, {sums} FROM official_parts GROUP BY 1, 2, 3, official_parts.player)"


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH plays AS (SELECT * FROM {{p}}), {official_sql()} SELECT * FROM official", p=plays(spark, sf_dir))
