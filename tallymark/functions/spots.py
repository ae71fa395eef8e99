"""Field spots: "PHI 30", "50", "OPP 0". Distances count yards to the goal line that the offense attacks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = re.compile(r"(?:([A-Z]{2,3}) )?(\d{1,2})")


def parse(spot: object) -> tuple[str | None, int] | None:
    """(team, yards from its goal line); midfield has no team. None for what is no spot."""
    m = _FORM.fullmatch(spot) if isinstance(spot, str) else None
    if m is None or int(m[2]) > 50 or (m[1] is None and int(m[2]) != 50):
        return None
    return (None, 50) if int(m[2]) == 50 else (m[1], int(m[2]))


def canonical(spot: object) -> str | None:
    found = parse(spot)
    return found and ("50" if found[0] is None else f"{found[0]} {found[1]}")


def yardline(spot: object, team: str) -> int | None:
    found = parse(spot)
    return found and (50 if found[0] is None else 100 - found[1] if found[0] == team else found[1])


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spot_team(spot: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(spot), r"^([A-Z]{2,3}) \d{1,2}$", 1), F.lit(""))


def spot_yards(spot: str | Column) -> Column:
    """Null for what is no spot."""
    n = F.regexp_extract(_c(spot), r"^(?:[A-Z]{2,3} )?(\d{1,2})$", 1).try_cast("int")
    return F.when((n == 50) | ((n < 50) & spot_team(spot).isNotNull()), n)


def canonical_spot(spot: str | Column) -> Column:
    n = spot_yards(spot)
    return F.when(n == 50, F.lit("50")).when(n < 50, F.concat(spot_team(spot), F.lit(" "), n.cast("string")))


def to_yardline(spot: str | Column, team: str | Column) -> Column:
    n, team = spot_yards(spot), _c(team)
    return F.when(F.coalesce(team, F.lit("")) != "", F.when(n == 50, 50).when(spot_team(spot) == team, 100 - n).when(n.isNotNull(), n))


def from_yardline(yards: str | Column, team: str | Column, other: str | Column) -> Column:
    """The spot of a distance; null off the field or without two teams."""
    y, team, other = _c(yards), _c(team), _c(other)
    text = F.when(y == 50, "50").when(y == 0, "OPP 0").when(y < 50, F.concat_ws(" ", other, y.cast("string"))).otherwise(F.concat_ws(" ", team, (100 - y).cast("string")))
    return F.when(y.between(0, 100) & (F.coalesce(team, F.lit("")) != "") & (F.coalesce(other, F.lit("")) != "") & (team != other), text)


def gained(start: str | Column, end: str | Column, team: str | Column) -> Column:
    return to_yardline(start, team) - to_yardline(end, team)


def advance(start: str | Column, yards: Column, team: str | Column, other: str | Column) -> Column:
    return from_yardline(to_yardline(start, team) - yards, team, other)


def line_of_scrimmage(yrdln: str = "yrdln", yardline_100: str = "yardline_100", team: str = "posteam", other: str = "defteam") -> Column:
    """The stated line, else the one computed from the distance."""
    return F.coalesce(canonical_spot(F.trim(yrdln)), from_yardline(F.bround(yardline_100).cast("int"), team, other))


def spot_kind(spot: str | Column, text: str | Column) -> Column:
    """literal where the text prints the spot, goal_line for an unprinted goal line, else computed."""
    spot, text = _c(spot), F.coalesce(_c(text), F.lit(""))
    middle = text.rlike(r"\b(?:to|at|from|on|MID|[A-Z]{2,3}) 50\b")
    printed = F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9-])"), spot, F.lit(r"(?!\d)")))
    return F.when(F.when(spot == "50", middle).otherwise(printed), "literal").when(spot_yards(spot) == 0, "goal_line").otherwise("computed")
