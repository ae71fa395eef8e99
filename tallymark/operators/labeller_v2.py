"""Labels in field spots: yardage credits say where the ball ended up, and where they began if not at the line of scrimmage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import STATS, YARDAGE, one_of
from tallymark.functions import spots
from tallymark.operators import labeller
from tallymark.operators.rules import filled, is_nullified, on, spelled


def _begin(flag: str, taker: str, before: str, yards: Column) -> tuple[Column, Column]:
    """(who, where) a lateral leg began: after the yards of the leg before it. Nobody where that is the same player."""
    who = F.when(on(flag) & filled(taker), spelled(taker))
    prior = F.when(filled(before), spelled(before))
    return F.when(~who.eqNullSafe(prior), who), spots.advance("los", F.coalesce(yards, F.lit(0)), "posteam", "defteam")


def labels_v2(plays: DataFrame) -> DataFrame:
    """One row per play: game_id, play_id, los, label_v2, round_trip, error.

    Each yardage credit ends where its start is advanced by its yards. If a spot falls off the field with laterals placed, all
    begin at the line of scrimmage; if one still does, there is no label, and the error says so. round_trip: the yards between
    the spots are the yards there were.
    """
    whole = lambda c: F.bround(F.nanvl(F.col(c), F.lit(None).cast("double"))).cast("int")
    rows = labeller.candidates(plays).withColumn("los", spots.line_of_scrimmage())
    catch_who, catch_at = _begin("lateral_reception", "lateral_receiver_player_name", "receiver_player_name", whole("receiving_yards"))
    rush_who, rush_at = _begin("lateral_rush", "lateral_rusher_player_name", "rusher_player_name", F.coalesce(whole("rushing_yards"), whole("receiving_yards")))
    rows = rows.withColumns({"ordered": labeller.merged_credits(F.col("emitted")), "w1": catch_who, "a1": catch_at, "w2": rush_who, "a2": rush_at})

    def placed(laterals: bool) -> Column:
        def one(e: Column) -> Column:
            legs = F.when((e["stat"] == "rec_yds") & (e["player"] == F.col("w1")), F.col("a1")).when((e["stat"] == "rush_yds") & (e["player"] == F.col("w2")), F.col("a2"))
            own = legs if laterals else F.lit(None).cast("string")
            start = F.coalesce(own, F.col("los"))
            moved = e["stat"].isin(list(YARDAGE))
            implied = spots.to_yardline(start, F.col("posteam")) == spots.to_yardline("los", F.col("posteam"))
            return F.struct(
                one_of(STATS, e["stat"]).alias("ord"), e["player"].alias("player"), F.when(~moved, e["value"]).alias("value"),
                F.when(moved & ~implied, start).alias("from"), F.when(moved, spots.advance(start, e["value"], "posteam", "defteam")).alias("to"), e["stat"].alias("stat"), e["value"].alias("yards"),
            )

        return F.transform("ordered", one)

    off = lambda c: F.exists(c, lambda e: e["stat"].isin(list(YARDAGE)) & e["to"].isNull())
    tried = rows.withColumns({"p1": placed(True), "p0": placed(False)})
    found = tried.withColumn("p", F.when(~off(F.col("p1")), F.col("p1")).when(~off(F.col("p0")), F.col("p0")))
    key = lambda e: F.struct(e["ord"].alias("ord"), e["player"].alias("player"), F.coalesce(e["value"], F.lit(0)).alias("v"), F.coalesce(e["from"], F.lit("")).alias("f"), F.coalesce(e["to"], F.lit("")).alias("t"), e.alias("e"))
    items = F.transform(F.array_sort(F.transform("p", key)), lambda k: F.struct(*(k["e"][c].alias(c) for c in ("player", "stat", "value", "from", "to"))))
    back = F.forall("p", lambda e: ~e["stat"].isin(list(YARDAGE)) | (spots.gained(F.coalesce(e["from"], F.col("los")), e["to"], F.col("posteam")) == e["yards"]))
    text = F.when(F.col("p").isNotNull(), F.to_json(F.struct(is_nullified().alias("nullified"), items.alias("credits"))))
    return found.select(*labeller.KEY, "los", text.alias("label_v2"), F.coalesce(back, F.lit(False)).alias("round_trip"), F.when(F.col("p").isNull(), F.lit("spot off the field")).alias("error"))
