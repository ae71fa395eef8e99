"""What the operators of this subpackage share: the folder that all machines see, bounded Arrow batches, text bytes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.plans.shared import shared_dir, stash  # noqa: F401  for the operators
from tallymark.plans.shipping import ship

#: Rows and bytes of an Arrow batch. Texts may be long, so the row count alone would not bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches of bounded size and this package on its workers."""
    spark = ship(df.sparkSession)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        set_now = spark.conf.get(key)
        if not (set_now.isdigit() and 0 < int(set_now) <= value):
            spark.conf.set(key, str(value))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def row_hash(docs: DataFrame, *names: str) -> Column:
    """A hash of what the columns hold, for telling apart rows that share an id; missing columns count as null."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in docs.columns else F.lit("\x00") for c in names))


def only_rows(docs: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """The rows of docs that wanted names by (doc_id, raw, n), of each n that are alike one. raw: `row_hash(docs, *names)`."""
    keys = wanted.select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), F.col("n").alias("__n"))
    keyed = docs.withColumn("__own", row_hash(docs, *names))
    met = (F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))) & (F.col("__own") == F.col("__raw"))
    found = keyed.join(keys.hint("shuffle_hash"), met)
    if keys.where("__n > 1").isEmpty():
        return found.select(*docs.columns)
    return found.where("__n = 1").select(*docs.columns).union(found.where("__n > 1").dropDuplicates(["__id", "__raw"]).select(*docs.columns))


def dumps(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))
