"""Files in and out: Parquet with a column list, JSON lines with required keys, append-only logs, deterministic sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_bad"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table's columns; a column that is not there is an error that names what is."""
    table = spark.read.parquet(path)
    lacking = [c for c in columns or [] if c not in table.columns]
    if lacking:
        raise ValueError(f"{path} has no {', '.join(lacking)}; it has {', '.join(table.columns)}")
    return table.select(*columns) if columns else table


def partitioned(spark: SparkSession, root: str, column: str, values: list) -> DataFrame:
    """Some partitions of a table that is laid out by a column; Spark reads those directories alone."""
    return spark.read.parquet(root).where(F.col(column).isin(values))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Records of a JSON-lines file of any codec Spark knows. Blank lines are skipped; a line that isn't JSON, or lacks a
    required key, fails the query with its text."""
    read = _json(spark, path, schema)
    wrong = F.when(F.col(_BAD).isNotNull(), F.raise_error(F.concat(F.lit("not a record: "), F.substring(_BAD, 1, 200))))
    for key in required:
        wrong = wrong.when(F.col(key).isNull(), F.raise_error(F.lit(f"a record has no {key}")))
    return read.withColumn("__ok", wrong.otherwise(True)).where("__ok").drop("__ok", _BAD)


def append_log(spark: SparkSession, path: str, schema: T.StructType, config: str | None = None) -> DataFrame:
    """Records of an append-only log; lines that are cut short are left out. A record of another configuration fails the query."""
    read = _json(spark, path, schema).where(F.col(_BAD).isNull()).drop(_BAD)
    if config is None:
        return read
    other = F.when(F.col("config_hash") != config, F.raise_error(F.lit("the log is of another configuration")))
    return read.withColumn("__ok", other.otherwise(True)).where("__ok").drop("__ok")


def skipped(spark: SparkSession, path: str, schema: T.StructType, own: Column) -> DataFrame:
    """One row: records read, malformed lines, records that aren't our own."""
    read = _json(spark, path, schema)
    bad = F.col(_BAD).isNotNull()
    return read.agg(F.sum(F.when(~bad & own, 1).otherwise(0)).alias("records"), F.sum(F.when(bad, 1).otherwise(0)).alias("malformed"), F.sum(F.when(~bad & ~own, 1).otherwise(0)).alias("others"))


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    return lines.select(F.from_json("value", full, options).alias("r")).select("r.*")


def json_text(columns: list[str]) -> Column:
    """A record as one line: keys in the order given, compact, text as it is."""
    return F.to_json(F.struct(*columns))


def write_json_lines(rows: DataFrame, path: str, columns: list[str], order: list[str], files: int = 1) -> None:
    """The same bytes for the same rows: ranges of the order are files, each sorted. A written directory appears whole or not at all."""
    placed = rows.repartitionByRange(files, *order) if files > 1 else rows.coalesce(1)
    placed.sortWithinPartitions(*order).select(json_text(columns).alias("value")).write.mode("overwrite").text(path)


def append(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(json_text(columns).alias("value")).write.mode("append").text(path)


def manifest(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """Rows, bytes and an order-free hash of each part of a dataset."""
    part = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length(line) + 1).alias("n_bytes"), F.bit_xor(part).alias("folded"))


def violations(rows: DataFrame, required: list[str], allowed: dict[str, list]) -> DataFrame:
    """(…, problem): rows that break a contract, each with its first problem. Nothing is dropped unseen."""
    found = F.coalesce(
        *(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required),
        *(F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.lit(f"{c} is outside its vocabulary")) for c, v in allowed.items()),
        F.lit(None).cast("string"),
    )
    return rows.withColumn("problem", found).where("problem is not null")


def first_rows(table: DataFrame, n: int) -> DataFrame:
    """The first n rows of a table's files in the order of their paths and lines: what a reader with a limit would have met.

    Each task keeps n rows at most. table: read from Parquet files, as rows' places come from the files.
    """
    placed = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.orderBy("__file", "__row").limit(n).drop("__file", "__row")
