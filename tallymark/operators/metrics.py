"""Scores of predictions: multisets of credits, per-group sums, ratios of sums."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import SCORING
from tallymark.plans.shipping import ship

PLAY = ["game_id", "play_id"]
CREDIT = ["player", "stat", "value"]


def multiset_counts(gold: DataFrame, pred: DataFrame, keys: list[str] = PLAY, item: list[str] = CREDIT) -> DataFrame:
    """tp, fp, fn of each key. One tagged union and one grouping: a credit that comes twice counts twice."""
    tagged = gold.select(*keys, *item, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*keys, *item, F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = tagged.groupBy(*keys, *item).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    tp = F.least("g", "p")
    return each.groupBy(*keys).agg(F.sum(tp).alias("tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


def scored_plays(plays: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """plays (with nullified, valid, strict, pred_nullified) with tp, fp, fn and exact."""
    counted = plays.join(multiset_counts(gold, pred), PLAY, "left").fillna(0, ["tp", "fp", "fn"])
    same = F.col("nullified").eqNullSafe(F.col("pred_nullified"))
    return counted.withColumn("exact", F.col("valid") & same & (F.col("fp") == 0) & (F.col("fn") == 0))


def _points(weights: dict[str, str]) -> Column:
    weight = F.coalesce(*(F.when(F.col("stat") == s, F.lit(Decimal(w)).cast("decimal(4,2)")) for s, w in weights.items()))
    return F.sum(F.col("value").cast("decimal(10,0)") * weight)


def game_errors(gold: DataFrame, pred: DataFrame, weights: dict[str, str] = SCORING["ppr"]) -> DataFrame:
    """Per game: absolute difference in points over players of either side, and how many players."""
    tagged = gold.select("game_id", "player", "stat", "value").unionByName(pred.select("game_id", "player", "stat", (-F.col("value")).alias("value")))
    player = tagged.groupBy("game_id", "player").agg(_points(weights).alias("off"))
    return player.groupBy("game_id").agg(F.sum(F.abs("off")).cast("decimal(18,2)").alias("abs_err"), F.count("*").alias("n_pairs"))


def game_sums(scored: DataFrame) -> DataFrame:
    """Sums by game and by (bucket, game) in one pass; bucket "all" is the former."""
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    sets = scored.groupingSets([["game_id"], ["bucket", "game_id"]], "bucket", "game_id")
    sums = sets.agg(
        F.count("*").alias("n"), one("valid").alias("valid"), one("strict").alias("strict_valid"), one("exact").alias("exact"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )
    return sums.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


RATIOS = {
    "valid_rate": ("valid", "n"), "strict_rate": ("strict_valid", "n"), "exact_match": ("exact", "n"),
    "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"),
}


def ratios(sums: DataFrame) -> DataFrame:
    """Sums with metrics; undefined ones are null."""
    return sums.withColumns({name: F.try_divide(F.expr(f"cast({a} as double)"), F.expr(f"cast({b} as double)")) for name, (a, b) in RATIOS.items()})


def bucket_metrics(scored: DataFrame) -> DataFrame:
    per = game_sums(scored).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", "valid", "strict_valid", "exact", "tp", "fp", "fn")))
    return ratios(per)


def validation_scores(scored: DataFrame, shares: DataFrame) -> DataFrame:
    """Micro, macro (mean over buckets) and natural (by population share, renormalised over met buckets) exact match.

    F1 without any credit is 1 here. shares: bucket, share.
    """
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    per = scored.groupBy("bucket").agg(F.count("*").alias("n"), one("exact").alias("exact"), one("valid").alias("valid"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    met = per.join(F.broadcast(shares), "bucket", "left").withColumn("em", F.col("exact") / F.col("n"))
    wide = 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")
    return met.agg(
        F.sum("n").alias("n"), (F.sum("exact") / F.sum("n")).alias("micro"), F.avg("em").alias("macro"), (F.sum(F.col("em") * F.col("share")) / F.sum("share")).alias("natural"),
        F.when(wide == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * F.sum("tp"), wide)).alias("f1"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a proportion; (0, 1) without any case."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p, d = k / m, 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0))


def contingency(a: DataFrame, b: DataFrame, keys: list[str] = PLAY) -> DataFrame:
    """(a_right, b_right, n) over the keys that both have."""
    both = a.select(*keys, F.col("exact").alias("a_right")).join(b.select(*keys, F.col("exact").alias("b_right")), keys)
    return both.groupBy("a_right", "b_right").agg(F.count("*").alias("n"))


def regressions(a: DataFrame, b: DataFrame, keys: list[str] = PLAY) -> DataFrame:
    """Keys that a has right and b has wrong."""
    return a.where("exact").select(*keys).join(b.where(~F.col("exact")).select(*keys), keys, "left_semi")


def custom_points(credits: DataFrame, score: Callable[[dict[str, int]], float]) -> DataFrame:
    """(game_id, player, points) by any function of a player's totals, also one that is not a sum of parts."""
    ship(credits.sparkSession)
    per = credits.groupBy("game_id", "player", "stat").agg(F.sum("value").cast("int").alias("value"))
    held = per.groupBy("game_id", "player").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("stat", "value")))).alias("totals"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["game_id", "player"]].assign(points=[float(score(json.loads(t))) for t in batch["totals"]])

    return held.mapInPandas(run, "game_id string, player string, points double")
