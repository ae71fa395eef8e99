"""Ranks, positions and running sums without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str, most: int) -> DataFrame:
    """rows that are among the first `most` of their group, with their rank from 1.

    The filter on the rank lets Spark keep `most` rows of a group in every task before the exchange, so what meets in one task
    is bounded by `most` and the number of tasks, whatever the group's size.
    """
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= most)


def numbered(rows: DataFrame, order: list[Column | str], name: str, by: list[str] | None = None) -> DataFrame:
    """rows with their position from 0 in an order whose first key is a hash in hexadecimal, within each of `by`.

    Blocks are ranges of the hash, so they are even. Their counts are summed up, and each block is ranked by itself: no task
    sees a whole group.
    """
    return _running(rows, order, name, F.lit(1), by or [])


def summed_before(rows: DataFrame, order: list[Column | str], name: str, value: str) -> DataFrame:
    """rows with the sum of `value` over all rows that come before, in blocks as above."""
    return _running(rows, order, name, F.col(value), [])


def _running(rows: DataFrame, order: list[Column | str], name: str, value: Column, by: list[str]) -> DataFrame:
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    keyed = rows.withColumns({"__o": first, "__v": value}).withColumn("__block", F.substring("__o", 1, 3))
    blocks = keyed.groupBy(*by, "__block").agg(F.sum("__v").alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__block") if by else Window.orderBy("__block")
    before = blocks.select(*by, "__block", (F.sum("__sum").over(ahead) - F.col("__sum")).alias("__before"))
    inside = F.sum("__v").over(Window.partitionBy(*by, "__block").orderBy("__o", *order[1:])) - F.col("__v")
    return keyed.join(before, [*by, "__block"]).withColumn(name, F.col("__before") + inside).drop("__o", "__v", "__block", "__before")
