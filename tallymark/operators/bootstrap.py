"""Cluster bootstrap on per-group sums: metrics are ratios of sums, so groups, not rows, are drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.metrics import RATIOS, ratios
from tallymark.plans.ranks import numbered

SUMS = ("n", "valid", "strict_valid", "exact", "tp", "fp", "fn")


def clusters(rows: DataFrame, key: str = "game_id") -> DataFrame:
    """(key, at): distinct clusters numbered from 0 by a hash."""
    return numbered(rows.select(key).distinct(), [F.md5(key), key], "at")


def draws(rows: DataFrame, n: int, resamples: int, seed: int) -> DataFrame:
    """(boot, at, w): how often each of n clusters is drawn in each resample. The draw is a hash, so any engine gives the same."""
    spark = rows.sparkSession
    spots = spark.range(resamples * n).select(F.expr(f"id div {max(n, 1)}").alias("boot"), (F.col("id") % max(n, 1)).alias("slot"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "boot", "slot")), 1, 8), 16, 10).cast("long") % max(n, 1)
    return spots.select("boot", drawn.alias("at")).groupBy("boot", "at").agg(F.count("*").alias("w"))


def resampled(sums: DataFrame, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(boot, bucket, sums): the same draws for all buckets. sums: bucket, game_id, SUMS."""
    games = clusters(sums)
    weights = draws(sums, games.count(), resamples, seed).join(games, "at")
    return weights.join(sums, "game_id").groupBy("boot", "bucket").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in SUMS))


def intervals(sums: DataFrame, resamples: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(bucket, metric, point, lo, hi). Undefined resamples are left out, and there is no interval for an undefined point."""
    point = _long(ratios(sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in SUMS))), ["bucket"]).withColumnRenamed("value", "point")
    boots = _long(ratios(resampled(sums, resamples, seed)), ["boot", "bucket"])
    ends = boots.groupBy("bucket", "metric").agg(F.percentile("value", alpha / 2).alias("lo"), F.percentile("value", 1 - alpha / 2).alias("hi"))
    known = point.join(ends, ["bucket", "metric"], "left")
    return known.withColumns({c: F.when(F.col("point").isNotNull(), F.col(c)) for c in ("lo", "hi")})


def _long(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in RATIOS))))


def paired(a: DataFrame, b: DataFrame, resamples: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(bucket, metric, diff, lo, hi) of b minus a under the same draws. Raises where not both have the same clusters."""
    games = [x.select("game_id").distinct() for x in (a, b)]
    alone = games[0].join(games[1], "game_id", "left_anti").union(games[1].join(games[0], "game_id", "left_anti"))
    if not alone.isEmpty():
        raise ValueError("paired systems must have the same clusters")
    metrics = lambda s: _long(ratios(resampled(s, resamples, seed)), ["boot", "bucket"])
    points = lambda s: _long(ratios(s.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in SUMS))), ["bucket"])
    both = metrics(a).join(metrics(b).withColumnRenamed("value", "other"), ["boot", "bucket", "metric"])
    ends = both.withColumn("d", F.col("other") - F.col("value")).groupBy("bucket", "metric").agg(F.percentile("d", alpha / 2).alias("lo"), F.percentile("d", 1 - alpha / 2).alias("hi"))
    diff = points(a).join(points(b).withColumnRenamed("value", "other"), ["bucket", "metric"]).select("bucket", "metric", (F.col("other") - F.col("value")).alias("diff"))
    return diff.join(ends, ["bucket", "metric"])


def verdict(differences: DataFrame, metric: str = "exact_match") -> DataFrame:
    """One row: earned, if the overall interval is above zero and no bucket's is below; and the reasons against, sorted."""
    rows = differences.where(F.col("metric") == metric)
    against = F.when((F.col("bucket") == "all") & (F.coalesce(F.col("lo"), F.lit(-1.0)) <= 0), F.lit("overall")).when((F.col("bucket") != "all") & (F.col("hi") < 0), F.col("bucket"))
    reasons = F.array_sort(F.collect_list(against))
    return rows.agg(reasons.alias("reasons")).select((F.size("reasons") == 0).alias("earned"), F.array_join("reasons", ",").alias("reasons"))
