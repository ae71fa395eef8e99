"""Totals of credits against totals from elsewhere: full outer join, agreement, classified mismatches."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import SCORING, STATS
from tallymark.operators.rules import normal_name

KEYS = ["game_id", "team", "player"]


def totals(credits: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One column per statistic, zero where a player has none. The pivot's values are given, so it takes one job."""
    wide = credits.groupBy(*keys).pivot("stat", list(STATS)).agg(F.sum("value"))
    return wide.select(*keys, *(F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in STATS))


def active(suffix: str = "") -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"{s}{suffix}") != 0 for s in STATS))


def points(weights: dict[str, str], suffix: str = "") -> Column:
    """Exact points of statistic columns: totals first, weights after."""
    return reduce(lambda a, b: a + b, (F.col(f"{s}{suffix}").cast("decimal(18,0)") * F.lit(Decimal(weights[s])).cast("decimal(4,2)") for s in STATS)).cast("decimal(18,2)")


def match(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Full outer join: statistics as <stat>_gt and <stat>_off, zero where a side lacks the key; in_gt and in_off tell."""
    a = left.select(*keys, *(F.col(s).alias(f"{s}_gt") for s in STATS), F.lit(True).alias("in_gt"))
    b = right.select(*keys, *(F.col(s).alias(f"{s}_off") for s in STATS), F.lit(True).alias("in_off"), *(c for c in right.columns if c not in keys and c not in STATS))
    both = a.join(b, keys, "full_outer")
    zero = {f"{s}_{side}": 0 for s in STATS for side in ("gt", "off")}
    return both.fillna(zero).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_gt", "in_off")})


def long_form(matched: DataFrame, carry: list[str]) -> DataFrame:
    """(carry, stat, gt, off) of a matched table."""
    cells = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(f"{s}_gt").alias("gt"), F.col(f"{s}_off").alias("off")) for s in STATS))
    return matched.select(*carry, F.inline(cells))


def agreement(matched: DataFrame) -> DataFrame:
    """Per statistic, over cells where either side is not zero: how many, how many equal, totals, absolute differences."""
    cells = long_form(matched, []).where("gt <> 0 or off <> 0")
    return cells.groupBy("stat").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("gt") == F.col("off"), 1).otherwise(0)).alias("n_equal"),
        F.sum("gt").alias("total_gt"), F.sum("off").alias("total_off"), F.sum(F.abs(F.col("gt") - F.col("off"))).alias("abs_diff"),
    )


def summary(matched: DataFrame, by: list[str], weights: dict[str, str] = SCORING["ppr"]) -> DataFrame:
    """Matched and one-sided players, how often all statistics agree, and the error in points."""
    off = F.abs(points(weights, "_gt") - points(weights, "_off"))
    agrees = reduce(lambda a, b: a & b, (F.col(f"{s}_gt") == F.col(f"{s}_off") for s in STATS))
    return matched.where(active("_gt") | active("_off")).withColumn("err", off).groupBy(*by).agg(
        F.count("*").alias("players"), F.sum(F.when(active("_gt") & active("_off"), 1).otherwise(0)).alias("matched"),
        F.sum(F.when(active("_gt") & ~active("_off"), 1).otherwise(0)).alias("left_only"), F.sum(F.when(~active("_gt") & active("_off"), 1).otherwise(0)).alias("right_only"),
        F.sum(F.when(agrees, 1).otherwise(0)).alias("all_agree"), F.sum("err").cast("decimal(18,2)").alias("abs_err"), F.max("err").cast("decimal(18,2)").alias("max_err"),
        F.sum(F.when(F.col("err") < F.lit(Decimal("0.011")), 1).otherwise(0)).alias("exact"),
    )


def rolled_up(summaries: DataFrame) -> DataFrame:
    """One row over all groups: rates weighted by players."""
    n = F.sum("players")
    return summaries.agg(
        n.alias("players"), (F.sum("all_agree") / n).alias("agree_rate"), (F.sum(F.col("left_only") + F.col("right_only")) / n).alias("unmatched_rate"),
        (F.sum("abs_err").cast("double") / n).alias("mae"), F.max("max_err").alias("max_err"),
    )


CLASSES = ("uncategorized_fumble", "kneel_excluded", "lateral", "desc_name_variant", "out_of_scope_play", "unexplained")


def mismatches(matched: DataFrame, kneelers: DataFrame, laterals: DataFrame, variants: DataFrame) -> DataFrame:
    """Each cell whose sides differ with its class: the first that applies.

    matched: with fumble_lost_total; kneelers: distinct KEYS; laterals: game_id, team, descr; variants: distinct KEYS.
    All lookups are equi-joins; a name is looked for in the texts of its own game and team only.
    """
    cells = long_form(matched, [*KEYS, "in_gt", "fumble_lost_total"]).where("gt <> off")
    named = cells.select(*KEYS).distinct().join(laterals, ["game_id", "team"]).where(F.contains("descr", "player")).select(*KEYS).distinct().withColumn("in_lateral", F.lit(True))
    teams = variants.select("game_id", "team").distinct().withColumn("team_varies", F.lit(True))
    known = (
        cells.join(kneelers.withColumn("knelt", F.lit(True)), KEYS, "left")
        .join(named, KEYS, "left")
        .join(variants.withColumn("varies", F.lit(True)), KEYS, "left")
        .join(teams, ["game_id", "team"], "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = {
        "uncategorized_fumble": (F.col("stat") == "fumble_lost") & F.col("gt").eqNullSafe(F.col("fumble_lost_total")),
        "kneel_excluded": (F.col("stat") == "rush_yds") & yes("knelt") & (F.col("gt") > F.col("off")),
        "lateral": yes("in_lateral"),
        "desc_name_variant": yes("varies") | (~F.col("in_gt") & yes("team_varies")),
        "out_of_scope_play": ~F.col("in_gt") & (F.col("gt") == 0),
    }
    kind = F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules.items()), F.lit("unexplained"))
    return known.select(*KEYS, "stat", "gt", "off", kind.alias("class"))


def class_counts(found: DataFrame) -> DataFrame:
    """Counts by class and statistic; classes without a cell are there with zero and a null statistic."""
    spark = found.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    counts = found.groupBy("class", "stat").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "class", "left").select("class", "stat", F.coalesce("n", F.lit(0)).alias("n"))


def credit_totals(credits: DataFrame) -> DataFrame:
    """Totals by game, team and normal name."""
    return totals(credits.withColumn("player", normal_name("player")))


def identity(ident: str, name: str) -> Column:
    """A player's key: the id, or "?" and the name where there is none."""
    return F.coalesce(F.col(ident), F.concat(F.lit("?"), F.col(name)))


def match_by_id(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, gt, off, in_gt, in_off: both sides' sums, whoever has the key. One row per key, so hot keys are summed before the join."""
    sums = [x.groupBy(*keys).agg(F.sum(value).cast("long").alias(c)).withColumn(f"in_{c}", F.lit(True)) for x, c in ((ours, "gt"), (theirs, "off"))]
    both = sums[0].join(sums[1], keys, "full_outer")
    return both.select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gt", "off")), *(F.coalesce(f"in_{c}", F.lit(False)).alias(f"in_{c}") for c in ("gt", "off")))


def ambiguous_ids(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, names: keys under which more than one name stands."""
    return rows.groupBy(*keys).agg(F.count_distinct(name).alias("names")).where("names > 1")


def explained(matched: DataFrame) -> DataFrame:
    """Lost fumbles where either side has any: how many equal, and how many equal the source's sum over all kinds of fumbles."""
    cells = matched.where("fumble_lost_gt <> 0 or fumble_lost_off <> 0")
    equal = F.col("fumble_lost_gt") == F.col("fumble_lost_off")
    told = equal | F.coalesce(F.col("fumble_lost_gt") == F.col("fumble_lost_total"), F.lit(False))
    return cells.agg(F.count("*").alias("n"), F.count_if(equal).alias("n_equal"), F.count_if(told).alias("n_explained"))
