"""Training-data operators: masks, padding, batch order, schedules, metric logs, cost."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.sampling import hash_order
from tallymark.plans.ranks import numbered

IGNORED = -100


def rounded_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def masked_labels(prompt: Column, completion: Column) -> Column:
    """Ignored for the prompt, ids for the completion."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), completion)


def padded(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), (width - F.size(ids)).cast("int")))


def within_length(rows: DataFrame, length: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rows that don't): nothing is dropped unseen."""
    return rows.where(length <= limit), rows.where(length > limit)


def batch_padding(rows: DataFrame, key: str, length: str, size: int, seed: int, multiple: int = 1) -> DataFrame:
    """One row: real tokens, and tokens when batches of `size` in hash order are padded to their longest row."""
    placed = numbered(rows.select(key, length), [hash_order(seed, key), key], "at")
    batches = placed.groupBy(F.floor(F.col("at") / size).alias("batch")).agg(F.max(length).alias("most"), F.count("*").alias("n"), F.sum(length).alias("real"))
    wide = rounded_up(F.col("most"), multiple) * F.col("n")
    return batches.agg(F.sum("real").cast("long").alias("real_tokens"), F.sum(wide).cast("long").alias("padded_tokens"), F.count("*").alias("batches"))


def epoch_stream(rows: DataFrame, key: str, epochs: int, size: int, seed: int) -> DataFrame:
    """(step, slot, epoch, key): steps take `size` rows in turn from the epochs' permutations, laid end to end."""
    n = rows.count()
    every = rows.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = numbered(every, [hash_order(seed, "epoch", key), key], "__at", ["epoch"]).withColumn("__at", F.col("epoch").cast("long") * n + F.col("__at"))
    return placed.select(F.floor(F.col("__at") / size).alias("step"), (F.col("__at") % size).alias("slot"), "epoch", key)


def learning_rate(step: Column, peak: float, warmup: int, total: int, floor: float) -> Column:
    """Linear to the peak, then a cosine down to the floor's share of it."""
    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * done))))


def early_stop(evals: DataFrame, run: str, step: str, value: str, patience: int) -> DataFrame:
    """evals (higher is better) with best so far, bad evaluations in a row, and whether the run stops here; later rows are gone."""
    order = Window.partitionBy(run).orderBy(step)
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = evals.withColumn("improved", before.isNull() | (F.col(value) > before)).withColumn("best", F.max(value).over(order))
    since = told.withColumn("__run", F.sum(F.col("improved").cast("int")).over(order))
    counted = since.withColumn("bad", (F.row_number().over(Window.partitionBy(run, "__run").orderBy(step)) - 1).cast("int"))
    stopped = counted.withColumn("__stops", F.sum(F.when(F.col("bad") >= patience, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return stopped.where(F.coalesce("__stops", F.lit(0)) == 0).withColumn("stop", F.col("bad") >= patience).drop("__run", "__stops")


def log_windows(log: DataFrame, run: str, step: str, loss: str, tokens: str, every: int) -> DataFrame:
    """(run, window, tokens, mean loss by token): sums over sums, not a mean of means."""
    window = F.ceil(F.col(step) / every).alias("window")
    return log.groupBy(run, window).agg(F.sum(tokens).alias("tokens"), F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)).alias("loss"))


def run_summary(log: DataFrame, run: str, step: str, loss: str, seconds: str) -> DataFrame:
    return log.groupBy(run).agg(F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss"), F.median(seconds).alias("median_s"), F.max(seconds).alias("max_s"), F.count("*").alias("steps"))


def last_kept(checkpoints: DataFrame, run: str, step: str, keep: int) -> DataFrame:
    """Checkpoints that go: all but the last `keep` of each run."""
    return checkpoints.withColumn("__k", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))).where(F.col("__k") > keep).drop("__k")


def cost(usage: DataFrame, by: list[str], prices: dict[str, float], rate: float) -> DataFrame:
    """usage (amounts map<string, double>, reported, latency_s, batch_size): totals, seconds, dollars.

    Reported cost first, else prices of the amounts, in millions; else seconds at a rate per hour. Latency is a batch's, so
    each row counts its share.
    """
    priced = sum((F.coalesce(F.element_at("amounts", k), F.lit(0.0)) * (p / 1e6) for k, p in prices.items()), F.lit(0.0))
    seconds = F.col("latency_s") / F.col("batch_size")
    each = F.coalesce("reported", F.when(F.size("amounts") > 0, priced), seconds * (rate / 3600))
    return usage.groupBy(*by).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"), F.sum(each).alias("dollars"), (1000 * F.sum(each) / F.count("*")).alias("dollars_per_1k"))


def token_shares(rows: DataFrame, prompt: str, completion: str, multiple: int, by: list[str]) -> DataFrame:
    total = F.col(prompt) + F.col(completion)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(prompt).cast("long").alias("prompt_tokens"), F.sum(completion).cast("long").alias("completion_tokens"), F.sum(rounded_up(total, multiple)).cast("long").alias("padded_tokens"),
    )


def few_shot(examples: DataFrame, key: str, order: str, system: str) -> DataFrame:
    """(key, messages): a system message, then each example's question and answer in turn. examples: key, order, question, answer."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    listed = examples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, pair.alias("pair")))).alias("__l"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return listed.select(key, F.concat(first, F.flatten(F.transform("__l", lambda x: x["pair"]))).alias("messages"))
