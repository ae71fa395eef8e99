"""From a play's columns to its credits: a long table (one row per credit), and the canonical label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import STATS, YARDAGE, one_of
from tallymark.operators.rules import filled, is_nullified, on, spelled

KEY = ["game_id", "play_id"]


def charged_fumbler() -> Column:
    """Who lost the ball for the offense; null for nobody.

    A slot counts when its fumbler is known and of the offense. A second slot without a name, but with a recovery, is
    the first fumbler's again. The first counting slot that another team recovered is charged; if no counting slot has a
    recovering team, the last one.
    """
    first, second = filled("fumbled_1_player_name"), filled("fumbled_2_player_name")
    again = ~second & first & F.col("fumble_recovery_2_team").isNotNull()
    who1 = F.when(first & F.col("fumbled_1_team").eqNullSafe(F.col("posteam")), F.col("fumbled_1_player_name"))
    who2 = F.when(second & F.col("fumbled_2_team").eqNullSafe(F.col("posteam")), F.col("fumbled_2_player_name")).when(again, who1)
    taken = [F.col(f"fumble_recovery_{k}_team").isNotNull() for k in (1, 2)]
    lost = [t & ~F.col(f"fumble_recovery_{k}_team").eqNullSafe(F.col("posteam")) for k, t in zip((1, 2), taken, strict=True)]
    unknown = (who1.isNull() | ~taken[0]) & (who2.isNull() | ~taken[1])
    return F.when(who1.isNotNull() & lost[0], who1).when(who2.isNotNull() & lost[1], who2).when(unknown, F.coalesce(who2, who1))


def _candidates() -> list[tuple[str, Column, Column, Column]]:
    """(statistic, whose name, value, condition) in the order in which credits are written down."""
    c, one = F.col, F.lit(1)
    whole = lambda name: F.bround(F.nanvl(c(name), F.lit(None).cast("double"))).cast("int")
    two, won = on("two_point_attempt"), F.coalesce(c("two_point_conv_result") == "success", F.lit(False))
    caught = filled("receiver_player_name")
    plain = ~two
    return [
        ("two_pt", c("passer_player_name"), one, two & won & caught),
        ("two_pt", c("receiver_player_name"), one, two & won & caught),
        ("two_pt", c("rusher_player_name"), one, two & won & ~caught),
        ("pass_yds", c("passer_player_name"), whole("passing_yards"), plain),
        ("rec", c("receiver_player_name"), one, plain & on("complete_pass")),
        ("rec_yds", c("receiver_player_name"), whole("receiving_yards"), plain),
        ("rush_yds", c("rusher_player_name"), whole("rushing_yards"), plain),
        ("rec_yds", c("lateral_receiver_player_name"), whole("lateral_receiving_yards"), plain & on("lateral_reception")),
        ("rush_yds", c("lateral_rusher_player_name"), whole("lateral_rushing_yards"), plain & on("lateral_rush")),
        ("int", c("passer_player_name"), one, plain & on("interception")),
        ("pass_td", c("passer_player_name"), one, plain & on("pass_touchdown")),
        ("rec_td", c("td_player_name"), one, plain & on("pass_touchdown")),
        ("rush_td", c("td_player_name"), one, plain & on("rush_touchdown")),
        ("fumble_lost", c("charged"), one, on("fumble_lost") & c("charged").isNotNull()),
    ]


def candidates(plays: DataFrame) -> DataFrame:
    """plays with `emitted`: all credits that a row implies, as (stat, player, value); player is null where the row has no name."""
    gone, structs = is_nullified(), []
    for stat, name, value, condition in _candidates():
        meant = ~gone & condition & value.isNotNull() & ((value != 0) if stat in YARDAGE else F.lit(True))
        structs.append(F.when(meant, F.struct(F.lit(stat).alias("stat"), name.alias("name"), value.alias("value"))))
    implied = plays.withColumn("charged", charged_fumbler()).withColumn("implied", F.filter(F.array(*structs), lambda x: x.isNotNull()))
    named = lambda e: F.when(F.coalesce(F.trim(e["name"]) != "", F.lit(False)), spelled(e["name"]))
    return implied.withColumn("emitted", F.transform("implied", lambda e: F.struct(e["stat"].alias("stat"), named(e).alias("player"), e["value"].alias("value"))))


def credits(plays: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per credit: the key, carried columns, player, stat, value.

    Yards of one player and statistic in a play are one credit, gone if they come to zero. Counts stay apart.
    """
    keys = [*KEY, *carry]
    rows = candidates(plays).select(*keys, F.posexplode("emitted").alias("at", "e")).select(*keys, "at", "e.*").where(F.col("player").isNotNull())
    yards = F.col("stat").isin(list(YARDAGE))
    apart = F.when(yards, F.lit(-1)).otherwise(F.col("at"))
    merged = rows.groupBy(*keys, "player", "stat", apart.alias("apart")).agg(F.sum("value").cast("int").alias("value"))
    return merged.where(~yards | (F.col("value") != 0)).drop("apart")


def merged_credits(emitted: Column) -> Column:
    """The same within a row: an array of (ord, player, value, stat) in canonical order."""
    named = F.filter(emitted, lambda e: e["player"].isNotNull())
    counts = F.filter(named, lambda e: ~e["stat"].isin(list(YARDAGE)))
    yards = F.filter(named, lambda e: e["stat"].isin(list(YARDAGE)))
    keys = F.array_distinct(F.transform(yards, lambda e: F.struct(e["stat"].alias("stat"), e["player"].alias("player"))))
    sums = F.transform(
        keys,
        lambda k: F.struct(
            k["stat"].alias("stat"),
            k["player"].alias("player"),
            F.aggregate(F.filter(yards, lambda e: (e["stat"] == k["stat"]) & (e["player"] == k["player"])), F.lit(0), lambda a, e: a + e["value"]).alias("value"),
        ),
    )
    both = F.concat(counts, F.filter(sums, lambda e: e["value"] != 0))
    return F.array_sort(F.transform(both, lambda e: F.struct(one_of(STATS, e["stat"]).alias("ord"), e["player"].alias("player"), e["value"].alias("value"), e["stat"].alias("stat"))))


def label_json(nullified: Column, ordered: Column) -> Column:
    """The canonical text of a label: fixed key order, compact, credits in canonical order."""
    items = F.transform(ordered, lambda e: F.struct(e["player"].alias("player"), e["stat"].alias("stat"), e["value"].alias("value")))
    return F.to_json(F.struct(nullified.alias("nullified"), items.alias("credits")))


def labels(plays: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per play: the key, carried columns, label, n_credits, dropped (statistics without a name), missing (names that the text lacks), noisy."""
    rows = candidates(plays)
    ordered = rows.withColumn("ordered", merged_credits(F.col("emitted")))
    body = F.coalesce(F.col("descr"), F.lit(""))
    return ordered.select(
        *KEY,
        *carry,
        label_json(is_nullified(), F.col("ordered")).alias("label"),
        F.size("ordered").alias("n_credits"),
        F.transform(F.filter("emitted", lambda e: e["player"].isNull()), lambda e: e["stat"]).alias("dropped"),
        F.array_sort(F.array_distinct(F.filter(F.transform("ordered", lambda e: e["player"]), lambda p: ~F.contains(body, p)))).alias("missing"),
        (~is_nullified() & ~on("two_point_attempt") & (on("lateral_reception") | on("lateral_rush"))).alias("noisy"),
    )
