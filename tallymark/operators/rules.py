"""Scope, condition flags, precedence buckets and name spelling, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import BUCKETS

SCOPE = ("pass", "run", "no_play")


def on(c: str | Column) -> Column:
    """A nullable 0/1 flag; NaN and null are off."""
    return F.coalesce(F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double")) == 1, F.lit(False))


def has(text: str | Column, pattern: str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(pattern)


def filled(c: str | Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def is_timeout(text: str = "descr") -> Column:
    """A no_play row that tells of no penalty, or of a timeout that doesn't wipe out a play."""
    return F.coalesce(F.col("play_type") == "no_play", F.lit(False)) & (~has(text, "(?i)penalty") | (has(text, r"^\s*Timeout\b") & ~has(text, "(?i)No Play")))


def scoped(rows: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Rows of the scope that have a text. What a scan can check by itself comes first, in a form that is pushed down."""
    wanted = F.col("play_type").isin([*SCOPE, *extra]) | (F.col("two_point_attempt") == 1)
    return rows.where(wanted & F.col("descr").isNotNull()).where(~is_timeout())


def timeouts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("play_type") == "no_play").where(is_timeout())


def is_nullified() -> Column:
    stands = on("two_point_attempt") & F.col("two_point_conv_result").isNotNull()
    return F.coalesce(F.col("play_type") == "no_play", F.lit(False)) & ~stands


def condition_flags() -> dict[str, Column]:
    """Conditions of a play; they may overlap."""
    gone = is_nullified()
    return {
        "lateral": on("lateral_reception") | on("lateral_rush") | has("descr", r"(?i)\bLateral to\b|\bPass back to\b"),
        "two_point": on("two_point_attempt") | has("descr", "(?i)TWO-POINT CONVERSION ATTEMPT"),
        "challenge": on("replay_or_challenge"),
        "interception": on("interception"),
        "fumble": on("fumble"),
        "penalty_stands": (on("penalty") | has("descr", r"(?i)\bpenalty on\b")) & ~gone,
        "td": on("touchdown"),
        "penalty_nullified": gone,
    }


def first_true(flags: Mapping[str, Column], otherwise: str) -> Column:
    """The name of the first flag that is on, in the mapping's order."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in flags.items()), F.lit(otherwise))


def bucket() -> Column:
    flags = condition_flags()
    return first_true({b: flags[b] for b in BUCKETS[:-1]}, BUCKETS[-1])


def flag_counts(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """How many rows satisfy each condition, and how many none: (condition, n)."""
    none = ~F.greatest(*flags.values())
    named = [F.struct(F.lit(k).alias("condition"), c.alias("on")) for k, c in {**flags, "normal": none}.items()]
    return rows.select(F.inline(F.array(*named))).groupBy("condition").agg(F.count_if("on").alias("n"))


def normal_name(name: str | Column) -> Column:
    """"D. Thomas" to "D.Thomas"."""
    return F.regexp_replace(name, r"^([A-Za-z]+)\.\s+", "$1.")


def spelled(name: str | Column, text: str = "descr") -> Column:
    """The name as the text spells it: itself, else its normal form if that is there, else itself."""
    name = F.col(name) if isinstance(name, str) else name
    body, normal = F.coalesce(F.col(text), F.lit("")), normal_name(name)
    return F.when(~F.contains(body, name) & F.contains(body, normal), normal).otherwise(name)
