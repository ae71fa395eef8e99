"""Closed vocabularies, weights and schemas. The values here are fixed: results depend on their exact spelling and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Statistics in canonical order; all but those of yards are counts.
STATS = ("pass_yds", "pass_td", "int", "rush_yds", "rush_td", "rec", "rec_yds", "rec_td", "fumble_lost", "two_pt")
YARDAGE = ("pass_yds", "rush_yds", "rec_yds")
#: Buckets from the first that applies to the last.
BUCKETS = ("lateral", "two_point", "challenge", "interception", "fumble", "penalty_stands", "td", "penalty_nullified", "normal")
#: Points for each statistic, by scoring.
POINTS = {"pass_yds": "0.04", "pass_td": "4", "int": "-2", "rush_yds": "0.1", "rush_td": "6", "rec_yds": "0.1", "rec_td": "6", "fumble_lost": "-2", "two_pt": "2"}
RECEPTION = {"standard": "0", "half_ppr": "0.5", "ppr": "1", "espn_14team_ppr": "1"}
SCORING = {name: {**POINTS, "rec": rec} for name, rec in RECEPTION.items()}
#: Seasons of each split.
SPLITS = {"train": range(2015, 2023), "val": range(2023, 2024), "test": range(2024, 2025)}
#: The per-group sums that all metrics are made of.
SUMS = ("n", "valid", "strict_valid", "exact", "tp", "fp", "fn", "abs_err", "n_pairs")
#: Prompt styles and the schema of the answers that each asks for.
STYLES = {"full": "v1", "minimal": "v1", "minimal_v2": "v2"}
CHECKS = ("schema", "yardage", "names", "agreement")

CREDIT = T.StructType([T.StructField("player", T.StringType()), T.StructField("stat", T.StringType()), T.StructField("value", T.IntegerType())])
LABEL = T.StructType([T.StructField("nullified", T.BooleanType()), T.StructField("credits", T.ArrayType(CREDIT))])


def one_of(values: tuple[str, ...] | list[str], c: Column) -> Column:
    """The position of c in a closed vocabulary, from 0; null outside."""
    found = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(found > 0, found - 1).cast("int")


def split_of(season: Column, splits: dict[str, range] = SPLITS) -> Column:
    """The split of a season; an unknown season raises."""
    out = F.raise_error(F.concat(F.lit("season without a split: "), season.cast("string")))
    for name, seasons in splits.items():
        out = F.when(season.isin(list(seasons)), F.lit(name)).otherwise(out)
    return out
