"""The dataset build: plays to frozen splits, a sample of the test split, and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.contracts import SPLITS, split_of
from tallymark.operators import labeller, rules, sampling
from tallymark.plans.shared import stash
from tallymark.sources import files
from tallymark.sources.plays import plays

#: The keys of a record in order; sizes and seeds of the samples.
RECORD = ["game_id", "play_id", "season", "week", "season_type", "posteam", "descr", "bucket", "label"]
ORDER = ["season", "game_id", "play_id"]
SUBSET, SUBSET_SEED = 50_000, 20151
CORE, LEAST, LITE_SEED = 2_400, 100, 20241


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with their split."""
    rows = rules.scoped(plays(spark, sf_dir)).withColumns({"split": split_of(F.col("season")), "bucket": rules.bucket()})
    return labeller.labels(rows, ("split", "season", "week", "season_type", "posteam", "descr", "bucket")).select("split", *RECORD)


def build(spark: SparkSession, sf_dir: str, out: str, core: int = CORE, least: int = LEAST, subset: int = SUBSET) -> DataFrame:
    """Write <out>/<split>, <out>/train_subset and <out>/eval_lite as JSON lines; returns the manifest by part and bucket.

    The same events give the same bytes: keys, order and samples are fixed, and samples are by hash.
    """
    found = stash(records(spark, sf_dir), "records")
    train = found.where("split = 'train'").withColumn("__all", F.lit("all"))
    parts = {split: found.where(F.col("split") == split) for split in SPLITS}
    parts["train_subset"] = sampling.stratified(train, "__all", ["game_id", "play_id"], {"all": subset}, SUBSET_SEED)
    lite = sampling.groups_and_top_up(parts["test"], "game_id", "bucket", ["game_id", "play_id"], core, least, LITE_SEED).withColumnRenamed("part", "eval_lite_part")
    for name, rows in parts.items():
        files.write_json_lines(rows, f"{out}/{name}", RECORD, ORDER)
    files.write_json_lines(lite, f"{out}/eval_lite", [*RECORD, "eval_lite_part"], ORDER)
    named = [rows.select(F.lit(name).alias("part"), *RECORD) for name, rows in {**parts, "eval_lite": lite}.items()]
    every = named[0]
    for rows in named[1:]:
        every = every.unionByName(rows)
    return files.manifest(every, ["part", "bucket"], files.json_text(RECORD))
