"""Rejection of noisy samples, budgets, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.contracts import CHECKS, YARDAGE
from tallymark.functions.labels_json import canonical, parse_label
from tallymark.functions.text import stated_yards, whole_name, without_fence


def decisions(samples: DataFrame, keys: list[str], k: int = 3, schema: bool = True, yardage: bool = True, names: bool = True, agreement: bool = True) -> DataFrame:
    """One row per play: the four checks (true, false, or null if off or not run), failed, keep, label.

    samples: keys, descr, sample (from 0), output. The first sample is the answer; all checks run, whichever failed before.
    Schema: all samples parse (only the first where off). Yardage and names: of the first sample's credits. Agreement: all
    samples parse to equal multisets. A play without sample 0 is dropped by schema.
    """
    parsed = samples.withColumn("label", parse_label(without_fence("output")))
    told = parsed.select(*keys, "descr", "sample", "label", canonical("label").alias("text"))
    play = told.groupBy(*keys).agg(
        F.max("descr").alias("descr"), F.count("*").alias("n"), F.count("text").alias("n_parsed"), F.count_distinct("text").alias("n_texts"),
        F.max(F.when(F.col("sample") == 0, F.col("text"))).alias("first"), F.max(F.when(F.col("sample") == 0, F.col("label"))).alias("label"),
    )
    found, none = F.col("first").isNotNull(), F.lit(None).cast("boolean")
    credits = F.col("label.credits")
    allowed = F.transform(F.filter(credits, lambda c: c["stat"].isin(list(YARDAGE))), lambda c: c["value"])
    stated = F.size(F.array_except(allowed, stated_yards("descr"))) == 0
    here = F.forall(credits, lambda c: whole_name(c["player"], F.col("descr")))
    checks = {
        "schema": (F.col("n_parsed") == F.col("n")) if schema else found,
        "yardage": F.when(found, stated) if yardage else none,
        "names": F.when(found, here) if names else none,
        "agreement": F.when(F.col("n") < 2, True).otherwise((F.col("n_parsed") == F.col("n")) & (F.col("n_texts") == 1)) if agreement else none,
    }
    out = play.withColumns(checks)
    failed = F.filter(F.array(*(F.when(~F.col(c), F.lit(c)) for c in CHECKS)), lambda c: c.isNotNull())
    return out.withColumn("failed", failed).select(*keys, *CHECKS, "failed", (F.col("first").isNotNull() & (F.size("failed") == 0)).alias("keep"), F.col("first").alias("answer"))


def drop_counts(found: DataFrame) -> DataFrame:
    """Per check: plays that fail it, that fail it first, that fail it alone. All checks are there."""
    failures = found.select(F.size("failed").alias("n"), F.posexplode("failed").alias("at", "check"))
    counts = failures.groupBy("check").agg(F.count("*").alias("failed"), F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("first"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("sole"))
    every = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CHECKS))).alias("check"))
    return every.join(counts, "check", "left").fillna(0)


def missing_samples(plays: DataFrame, samples: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, missing): which of the k samples each play lacks; complete plays are left out."""
    have = samples.groupBy(*keys).agg(F.collect_set("sample").alias("have"))
    lack = F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.coalesce("have", F.array().cast("array<int>"))))
    return plays.select(*keys).distinct().join(have, keys, "left").select(*keys, lack.alias("missing")).where(F.size("missing") > 0)


def pending(rows: DataFrame, done: DataFrame, keys: list[str], config: str) -> DataFrame:
    """rows whose key the cache lacks. A cache of another configuration fails the query."""
    fenced = done.withColumn("__same", F.when(F.col("config_hash") != config, F.raise_error(F.lit("the cache is of another configuration"))).otherwise(True)).where("__same")
    return rows.join(fenced.select(*keys).distinct(), keys, "left_anti")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).where("__k = 1").drop("__k")


def within_budget(requests: DataFrame, order: list[str], cost: Column, limit: Column) -> DataFrame:
    """(…, spent): requests in order while the running cost stays within the limit.

    Costs are summed in blocks first, so the ordered sum runs over blocks, and only the block at the limit is summed row by row.
    """
    keyed = requests.withColumn("__cost", cost).withColumn("__block", F.floor(F.col(order[0]) / 1024))
    blocks = keyed.groupBy("__block").agg(F.sum("__cost").alias("__sum"))
    before = blocks.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.sum("__cost").over(Window.partitionBy("__block").orderBy(*order))
    summed = keyed.join(before, "__block").withColumn("spent", F.col("__before") + inside)
    return summed.where(F.col("spent") <= limit).drop("__cost", "__block", "__before")


def precision(kept: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Kept answers against the truth by bucket: kept, evaluated, correct. Answers without a truth are counted, not failed."""
    joined = kept.join(truth.select(*keys, "bucket", F.col("label").alias("__truth")), keys, "left")
    return joined.groupBy("bucket").agg(
        F.count("*").alias("kept"), F.count("__truth").alias("evaluated"), F.sum(F.when(F.col("answer") == F.col("__truth"), 1).otherwise(0)).alias("correct"),
    )


def teacher_view(records: DataFrame) -> DataFrame:
    """What a teacher may see of a record: keys and text, never a label. Raises where a column that is let through holds labels."""
    allowed = [c for c in ("game_id", "play_id", "posteam", "yrdln", "descr") if c in records.columns]
    view = records.select(*allowed)
    if leaked := [f.name for f in view.schema if not isinstance(f.dataType, T.StringType | T.IntegralType | T.DoubleType)]:
        raise ValueError(f"a teacher must not see {leaked}")
    return view


def common_to(arms: DataFrame, arm: str, one: str, keys: list[str]) -> DataFrame:
    """The rows of all arms whose keys one arm has."""
    return arms.join(arms.where(F.col(arm) == one).select(*keys).distinct(), keys, "left_semi")


def in_manifest_order(manifest: DataFrame, keys: str, rows: DataFrame, key: str) -> DataFrame:
    """at and the rows' columns, for the keys that a manifest lists (an array), by their place in it."""
    listed = manifest.select(F.posexplode(keys).alias("at", key))
    return listed.join(rows, key)
