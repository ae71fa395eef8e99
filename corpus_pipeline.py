"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
`documents`; the last returns the pieces of the packed sequences. Null and empty texts fail the quality rules and go. Rows are told
apart by their id and text: rows that share an id, or have none, are judged each for itself, and of rows that repeat both one
stays. A very long text is a row like others. An empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import exact_dedup, packing, pii, quality, simhash_wide
from tallymark.llm._shared import stash, table
from tallymark.llm.queries import pii_key, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_rows(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id stays."""
    return exact_dedup.kept_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts alike by 0.8 or more in shingles of five words, one row with the smallest id stays."""
    return simhash_wide.kept_rows(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values in the texts become pseudonyms."""
    return pii.rewritten_rows(docs, pii_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences."""
    return packing.pack(docs, tokens())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The tokenizer, the fingerprints and the keyed permutation can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
