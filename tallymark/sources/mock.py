"""Predictions and teacher samples with known errors, so that what is computed from them is known too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import YARDAGE


def predictions(plays: DataFrame, credits: DataFrame, system: str) -> tuple[DataFrame, DataFrame]:
    """(plays with valid, strict, pred_nullified; long credits) of a system that errs by play_id.

    plays: game_id, play_id, nullified, ..; credits: game_id, play_id, player, stat, value. System "a" errs by play_id % 11: 0 no
    answer, 1 yards one off, 2 no receptions, 3 a credit too many, 4 receptions twice, 5 nullified, 6 prose around it. System
    "b" errs by (3 * play_id + 1) % 13: 0 no answer, 1 yards two off.
    """
    kind = F.col("play_id") % 11 if system == "a" else (F.col("play_id") * 3 + 1) % 13
    err = F.when(kind == 0, "none").when(kind == 1, "yards")
    if system == "a":
        err = err.when(kind == 2, "fewer").when(kind == 3, "more").when(kind == 4, "twice").when(kind == 5, "nullified").when(kind == 6, "prose")
    err = err.otherwise("right")
    told = plays.withColumn("err", err).withColumns({
        "valid": F.col("err") != "none", "strict": ~F.col("err").isin("none", "prose"),
        "pred_nullified": F.when(F.col("err") == "none", F.lit(None)).when(F.col("err") == "nullified", True).otherwise(F.col("nullified")),
    }).drop("err")
    by = 1 if system == "a" else 2
    kept = credits.withColumn("err", err).where(~F.col("err").isin("none", "nullified") & ~((F.col("err") == "fewer") & (F.col("stat") == "rec")))
    off = F.when((F.col("err") == "yards") & F.col("stat").isin(list(YARDAGE)), by).otherwise(0)
    moved = kept.withColumn("value", (F.col("value") + off).cast("int"))
    twice = moved.where((F.col("err") == "twice") & (F.col("stat") == "rec"))
    more = plays.withColumn("err", err).where("err = 'more'").select("game_id", "play_id", F.lit("X.Extra").alias("player"), F.lit("rush_yds").alias("stat"), F.lit(5).alias("value"))
    cols = ["game_id", "play_id", "player", "stat", "value"]
    return told, moved.select(*cols).unionByName(twice.select(*cols)).unionByName(more)


EMPTY = '{"nullified":false,"credits":[]}'


def teacher_samples(labels: DataFrame, k: int = 3) -> DataFrame:
    """(game_id, play_id, descr, sample, output): k samples a play, with an error by play_id % 7.

    0 none; 1 the first is cut short; 2 the second is empty; 3 the first has yards that the text doesn't state; 4 all have a
    name that the text lacks; 5 all are fenced; 6 the third is missing.
    """
    mode = F.col("play_id") % 7
    name = F.regexp_replace("label", r'"credits":\[', '"credits":[{"player":"Z.Nobody","stat":"rec","value":1},').cast("string")
    name = F.regexp_replace(name, r",\]", "]")
    yards = F.regexp_replace(F.regexp_replace("label", r'"credits":\[', '"credits":[{"player":"V.Marlow","stat":"rush_yds","value":777},'), r",\]", "]")
    out = (
        F.when((mode == 1) & (F.col("sample") == 0), F.expr("substring(label, 1, length(label) - 1)"))
        .when((mode == 2) & (F.col("sample") == 1), F.lit('{"nullified":false,"credits":[{"player":"Q.Other","stat":"int","value":1}]}'))
        .when((mode == 3) & (F.col("sample") == 0), yards)
        .when(mode == 4, name)
        .when(mode == 5, F.concat(F.lit("```json\n"), F.col("label"), F.lit("\n```")))
        .otherwise(F.col("label"))
    )
    rows = labels.where(F.col("label").startswith('{"nullified":false')).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.where((mode != 6) | (F.col("sample") < 2)).select("game_id", "play_id", "bucket", "descr", "sample", out.alias("output"))
