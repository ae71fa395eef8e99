"""Text functions over play descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.contracts import STYLES


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after_reversal(text: str | Column) -> Column:
    """What follows the last reversal; the whole text without one."""
    return F.element_at(F.split(_col(text), r"play was REVERSED\."), -1)


def stated_gain(text: str | Column) -> Column:
    """The first gain after the last reversal: yards, 0 for "no gain", else null."""
    found = F.regexp_extract(after_reversal(text), r"(for no gain|for (-?\d+) yards?)", 0)
    number = F.regexp_extract(found, r"(-?\d+)", 1)
    return F.when(found == "for no gain", F.lit(0)).when(number != "", number.try_cast("int"))


def stated_yards(text: str | Column) -> Column:
    """All yards that gain phrases state, without repeats, ascending. Losses are negative; other dashes count as minus."""
    plain = F.translate(_col(text), "−–—", "---")
    number = r"(?i)\bfor\s+(?:a\s+(?:loss|gain)\s+of\s+)?-?\d+\s+(?:yards?|yds?)\b"
    phrases = F.regexp_extract_all(plain, F.lit(number), F.lit(0))

    def value(p: Column) -> Column:
        n = F.regexp_extract(p, r"(-?\d+)", 1).cast("int")
        return F.when(p.rlike(r"(?i)\bloss\b"), -F.abs(n)).otherwise(n)

    none = F.when(plain.rlike(r"(?i)\bfor\s+no\s+gain\b"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(phrases, value), none)))


def whole_name(name: str | Column, text: str | Column) -> Column:
    """Whether the name stands in the text as a whole: not after a letter, point or apostrophe, not before a letter, apostrophe or hyphenated letter."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(_col(name), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = F.regexp_like(_col(text), F.concat(F.lit(r"(?<![A-Za-z.'])"), quoted, F.lit(r"(?![A-Za-z']|-[A-Za-z])")))
    return F.coalesce((_col(name) != "") & found, F.lit(False))


def without_names(text: str | Column) -> Column:
    """A description for retrieval: no clock, players as PLAYER, spots as SPOT, other digits as #."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"^\(\d{0,2}:\d{2}\)\s*", "")
    t = F.regexp_replace(t, r"\b(?:[A-Z]{2,3}-)?\d{1,2}-[A-Z][A-Za-z']*\. ?[A-Za-z][A-Za-z'\-]*", " PLAYER ")
    t = F.regexp_replace(t, r"\b[A-Z]{2,3} \d{1,2}\b", " SPOT ")
    return F.regexp_replace(t, r"\d+", "#")


def record_key(game: str = "game_id", play: str = "play_id") -> Column:
    return F.concat_ws("#", game, play)


def play_key(value: str | Column) -> Column:
    """55, 55.0 and "55" are one key."""
    return F.coalesce(_col(value).try_cast("double").cast("long").cast("string"), _col(value).cast("string"))


def tokens_estimated(text: str | Column) -> Column:
    """A quarter of the characters, rounded to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.char_length(_col(text)) / 4).cast("int"))


def without_fence(text: str | Column) -> Column:
    """The text without one surrounding code fence."""
    t = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.when(t.rlike(r"(?s)^```[A-Za-z]*\s*\n?.*?\n?\s*```$"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))).otherwise(t)


def user_turn(text: str | Column, team: str | Column, los: str | Column | None = None) -> Column:
    """The user's message for one play; with the line of scrimmage in the second version."""
    known = lambda c: F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("UNK"))
    lines = [F.concat(F.lit("posteam: "), known(team))]
    if los is not None:
        lines.append(F.concat(F.lit("los: "), known(los)))
    return F.concat_ws("\n", *lines, F.concat(F.lit("desc: "), F.coalesce(_col(text), F.lit(""))))


def messages(text: str | Column, team: str | Column, los: str | Column, style: str, system: str | None = None) -> Column:
    """The chat messages of a play as (role, content). Only the full style has a system message, and must have one."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style}; known: {', '.join(STYLES)}")
    if (system is not None) != (style == "full"):
        raise ValueError(f"style {style} {'needs' if style == 'full' else 'has no'} system message")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = turn("user", user_turn(text, team, los if STYLES[style] == "v2" else None))
    return F.array(*([turn("system", F.lit(system))] if system is not None else []), user)


def style_schema(style: str, schema: str | None = None) -> str:
    """The schema that a style's answers have; another one asked for is an error."""
    if style not in STYLES or schema not in (None, STYLES[style]):
        raise ValueError(f"style {style} goes with {STYLES.get(style, 'nothing')}, not {schema}")
    return STYLES[style]
