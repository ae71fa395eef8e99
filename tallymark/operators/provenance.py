"""Hashes of record sets, joins that must be complete, keys that must be unique."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_hash(rows: DataFrame, by: list[str], order: list[str], line: Column) -> DataFrame:
    """SHA-256 of each group's lines in order, joined by line feeds: a file's identity.

    A group is gathered into one value, as a file would be; `unordered_hash` is for groups of any size.
    """
    lined = rows.select(*by, F.struct(*order, line.alias("__line")).alias("r"))
    sorted_lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["__line"])
    return lined.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(sorted_lines, "\n"), 256).alias("sha"))


def unordered_hash(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """XOR of 60 bits of each line's MD5: the same for any order, in constant memory."""
    part = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(part).alias("folded"))


def config_hash(config: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def source_hash(root: str | Path) -> str:
    """SHA-256 over a directory's Python files, by name and content."""
    digest = hashlib.sha256()
    for path in sorted(Path(root).rglob("*.py")):
        digest.update(path.relative_to(root).as_posix().encode() + b"\0" + hashlib.sha256(path.read_bytes()).digest())
    return digest.hexdigest()


def directory_hash(files: DataFrame) -> DataFrame:
    """SHA-256 over name and content of files, hidden ones left out. files: of Spark's binaryFile source, with a `name` relative to the directory."""
    shown = files.where(~F.col("name").rlike(r"(^|/)\."))
    return ordered_hash(shown.withColumn("all", F.lit(1)), ["all"], ["name"], F.concat_ws(" ", "name", F.sha2("content", 256))).drop("all")


def join_or_fail(rows: DataFrame, other: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """Join on keys; a row without a partner, or with one for which `same` is false, fails the query."""
    joined = rows.join(other.withColumn("__met", F.lit(True)), keys, "left")
    told = F.when(F.col("__met").isNull(), F.raise_error(F.concat(F.lit("no partner: "), F.concat_ws("#", *keys)))).when(~same, F.raise_error(F.concat(F.lit("differs: "), F.concat_ws("#", *keys)))).otherwise(True)
    return joined.withColumn("__met", told).where("__met").drop("__met")


def unique_or_fail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, or an error that names a key that comes twice."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("__n", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws("#", *keys))).cast("long")).otherwise(n)).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window

    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: (keys, side)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))
