"""Sparse TF-IDF: top-k most similar texts of other groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.plans.ranks import ranked


def terms(rows: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, term, tf): words and pairs of words, `[A-Za-z#]+`."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z#]+"), F.lit(0))
    listed = rows.select(key, *carry, words.alias("__w"))
    pairs = F.when(F.size("__w") > 1, F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda i: F.concat_ws(" ", F.get("__w", i - 1), F.get("__w", i)))).otherwise(F.array().cast("array<string>"))
    return listed.select(key, *carry, F.explode(F.concat("__w", pairs)).alias("term")).groupBy(key, *carry, "term").agg(F.count("*").alias("tf"))


def weights(found: DataFrame, key: str, n: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, term, w): sublinear tf times smooth idf, each text of length 1."""
    idf = found.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1).alias("idf"))
    raw = found.join(idf, "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, *carry, "term", (F.col("raw") / F.col("norm")).alias("w"))


def top_k(queries: DataFrame, corpus: DataFrame, key: str, group: str, k: int) -> DataFrame:
    """(key, other, sim, rank) for each query: the k most similar texts of other groups, ties by key, rank 1 the best.

    queries, corpus: key, group, term, w. Only texts that share a term meet; rank runs over a bounded prefix of each query.
    """
    q = queries.select(F.col(key).alias("q"), F.col(group).alias("__qg"), "term", F.col("w").alias("__qw"))
    d = corpus.select(F.col(key).alias("other"), F.col(group).alias("__dg"), "term", F.col("w").alias("__dw"))
    met = q.join(d, "term").where(~F.col("__qg").eqNullSafe(F.col("__dg")))
    sims = met.groupBy("q", "other").agg(F.round(F.sum(F.col("__qw") * F.col("__dw")), 9).alias("sim"))
    return ranked(sims.withColumn("__s", -F.col("sim")), ["q"], ["__s", "other"], "rank", k).drop("__s").withColumnRenamed("q", key)
