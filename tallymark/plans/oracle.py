"""SQL for DuckDB that the plays' queries are checked against, written apart from the operators."""

from __future__ import annotations

from tallymark.contracts import BUCKETS, SCORING, STATS
from tallymark.sources import plays as P

TIMEOUT = "(coalesce(play_type = 'no_play', false) AND (NOT contains(lower(coalesce(descr, '')), 'penalty') OR (regexp_matches(coalesce(descr, ''), '^\\s*Timeout\\b') AND NOT contains(lower(coalesce(descr, '')), 'no play'))))"
SCOPE = f"((coalesce(play_type IN ('pass', 'run', 'no_play'), false) OR coalesce(two_point_attempt, 0) = 1) AND NOT {TIMEOUT})"
NULLIFIED = "(coalesce(play_type = 'no_play', false) AND NOT (coalesce(two_point_attempt, 0) = 1 AND two_point_conv_result IS NOT NULL))"
FLAGS = {
    "lateral": "(coalesce(lateral_reception, 0) = 1 OR coalesce(lateral_rush, 0) = 1 OR contains(lower(coalesce(descr, '')), 'lateral to') OR contains(lower(coalesce(descr, '')), 'pass back to'))",
    "two_point": "(coalesce(two_point_attempt, 0) = 1 OR contains(lower(coalesce(descr, '')), 'two-point conversion attempt'))",
    "challenge": "coalesce(replay_or_challenge, 0) = 1",
    "interception": "coalesce(interception, 0) = 1",
    "fumble": "coalesce(fumble, 0) = 1",
    "penalty_stands": f"((coalesce(penalty, 0) = 1 OR contains(lower(coalesce(descr, '')), 'penalty on')) AND NOT {NULLIFIED})",
    "td": "coalesce(touchdown, 0) = 1",
    "penalty_nullified": NULLIFIED,
}
BUCKET = "CASE " + " ".join(f"WHEN {FLAGS[b]} THEN '{b}'" for b in BUCKETS[:-1]) + " ELSE 'normal' END"
SPLIT = "CASE WHEN season BETWEEN 2015 AND 2022 THEN 'train' WHEN season = 2023 THEN 'val' WHEN season = 2024 THEN 'test' END"
ORD = "CASE stat " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATS)) + " END"

_NAMED = lambda c: f"{c} IS NOT NULL AND trim({c}) <> ''"
_TWO = "two_point_attempt = 1 AND two_point_conv_result = 'success'"
_IMPLIED = [
    ("two_pt", "passer_player_name", "1", f"{_TWO} AND {_NAMED('receiver_player_name')}"),
    ("two_pt", "receiver_player_name", "1", f"{_TWO} AND {_NAMED('receiver_player_name')}"),
    ("two_pt", "rusher_player_name", "1", f"{_TWO} AND NOT ({_NAMED('receiver_player_name')})"),
    ("pass_yds", "passer_player_name", "passing_yards", "two_point_attempt = 0 AND passing_yards <> 0"),
    ("rec", "receiver_player_name", "1", "two_point_attempt = 0 AND complete_pass = 1"),
    ("rec_yds", "receiver_player_name", "receiving_yards", "two_point_attempt = 0 AND receiving_yards <> 0"),
    ("rush_yds", "rusher_player_name", "rushing_yards", "two_point_attempt = 0 AND rushing_yards <> 0"),
    ("rec_yds", "lateral_receiver_player_name", "lateral_receiving_yards", "two_point_attempt = 0 AND lateral_reception = 1 AND lateral_receiving_yards <> 0"),
    ("int", "passer_player_name", "1", "two_point_attempt = 0 AND interception = 1"),
    ("pass_td", "passer_player_name", "1", "two_point_attempt = 0 AND pass_touchdown = 1"),
    ("rec_td", "td_player_name", "1", "two_point_attempt = 0 AND pass_touchdown = 1"),
    ("rush_td", "td_player_name", "1", "two_point_attempt = 0 AND rush_touchdown = 1"),
    (
        "fumble_lost", "fumbled_1_player_name", "1",
        "fumble_lost = 1 AND fumbled_1_team = posteam AND ((fumble_recovery_1_team IS NOT NULL AND fumble_recovery_1_team <> posteam) "
        "OR (fumble_recovery_2_team IS NOT NULL AND fumble_recovery_2_team <> posteam) OR (fumble_recovery_1_team IS NULL AND fumble_recovery_2_team IS NULL))",
    ),
]


def plays_sql() -> str:
    """The plays, made once: each branch that reads them would render them again."""
    return P.plays_sql().replace("plays AS (", "plays AS MATERIALIZED (", 1)


def official_sql() -> str:
    return P.official_sql().replace("official AS (", "official AS MATERIALIZED (", 1)


def scoped(extra: str = "") -> str:
    where = SCOPE if not extra else SCOPE.replace("'no_play')", f"'no_play', {extra})", 1)
    return f"WITH {plays_sql()}, sc AS MATERIALIZED (SELECT * FROM plays WHERE {where} AND descr IS NOT NULL)"


def implied(source: str = "sc") -> str:
    return " UNION ALL ".join(
        f"SELECT game_id, play_id, posteam AS team, season, season_type, descr, '{stat}' AS stat, {i} AS at, {name} AS name, CAST({value} AS INT) AS value FROM {source} WHERE NOT {NULLIFIED} AND {where}"
        for i, (stat, name, value, where) in enumerate(_IMPLIED)
    )


def credits(extra: str = "") -> str:
    """WITH list up to `credits`: game_id, play_id, team, season, season_type, player, stat, value."""
    spelled = "CASE WHEN NOT contains(descr, name) AND contains(descr, regexp_replace(name, '^([A-Za-z]+)\\.\\s+', '\\1.')) THEN regexp_replace(name, '^([A-Za-z]+)\\.\\s+', '\\1.') ELSE name END"
    return f"""{scoped(extra)}, implied AS MATERIALIZED ({implied()}),
        named AS (SELECT *, {spelled} AS player FROM implied WHERE {_NAMED('name')}),
        credits AS MATERIALIZED (
            SELECT game_id, play_id, team, season, season_type, player, stat, CAST(sum(value) AS INT) AS value FROM named
            WHERE stat IN ('pass_yds', 'rush_yds', 'rec_yds') GROUP BY ALL HAVING sum(value) <> 0
            UNION ALL SELECT game_id, play_id, team, season, season_type, player, stat, value FROM named WHERE stat NOT IN ('pass_yds', 'rush_yds', 'rec_yds'))"""


def labels(extra: str = "") -> str:
    """WITH list up to `labels`: one row per scoped play with its canonical label."""
    item = """'{"player":"' || player || '","stat":"' || stat || '","value":' || value || '}'"""
    return f"""{credits(extra)}, items AS (SELECT game_id, play_id, string_agg({item}, ',' ORDER BY {ORD}, player, value) AS items, count(*) AS n FROM credits GROUP BY ALL),
        labels AS MATERIALIZED (SELECT sc.*, {NULLIFIED} AS nullified, {BUCKET} AS bucket, {SPLIT} AS split,
            '{{"nullified":' || CASE WHEN {NULLIFIED} THEN 'true' ELSE 'false' END || ',"credits":[' || coalesce(items, '') || ']}}' AS label, coalesce(n, 0) AS n_credits
            FROM sc LEFT JOIN items USING (game_id, play_id))"""


def matched(extra: str = "") -> str:
    """WITH list up to `matched`: the full outer join of totals."""
    sums = ", ".join(f"CAST(sum(CASE WHEN stat = '{s}' THEN value ELSE 0 END) AS BIGINT) AS {s}" for s in STATS)
    sides = ", ".join(f"coalesce(g.{s}, 0) AS {s}_gt, coalesce(o.{s}, 0) AS {s}_off" for s in STATS)
    return f"""{credits(extra)}, {official_sql()},
        gt AS (SELECT game_id, team, regexp_replace(player, '^([A-Za-z]+)\\.\\s+', '\\1.') AS player, {sums} FROM credits GROUP BY 1, 2, 3),
        matched AS MATERIALIZED (SELECT coalesce(g.game_id, o.game_id) AS game_id, coalesce(g.team, o.team) AS team, coalesce(g.player, o.player) AS player, {sides},
            g.game_id IS NOT NULL AS in_gt, o.game_id IS NOT NULL AS in_off, o.fumble_lost_total
            FROM gt g FULL OUTER JOIN official o ON g.game_id = o.game_id AND g.team = o.team AND g.player = o.player)"""


def points(config: str, suffix: str = "") -> str:
    return "CAST(" + " + ".join(f"{s}{suffix} * CAST('{SCORING[config][s]}' AS DECIMAL(4,2))" for s in STATS) + " AS DECIMAL(18,2))"


def any_of(suffix: str) -> str:
    return "(" + " OR ".join(f"{s}{suffix} <> 0" for s in STATS) + ")"


def cells(source: str = "matched", carry: str = "game_id, team, player, in_gt, fumble_lost_total") -> str:
    return " UNION ALL ".join(f"SELECT {carry}, '{s}' AS stat, {s}_gt AS gt, {s}_off AS \"off\" FROM {source}" for s in STATS)
