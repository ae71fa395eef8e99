"""Releases: an append-only log of events, the state that it amounts to, and the gate before a promotion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.plans.shipping import ship

EPS = 1e-9


def gate(candidate: DataFrame, current: DataFrame, min_valid: float = 0.95, floor: float = 0.0, tolerance: float = 1.0, least: int = 30, enforce_small: bool = False) -> DataFrame:
    """(model, check, passed, reason): all five checks of each candidate.

    candidate: model, sha, bucket, n, exact_match, valid_rate; bucket "all" is the overall row. current: the same without
    model; empty before the first promotion, which the comparing checks pass. Tolerance is in points of a hundred. A bucket
    with fewer than `least` cases on either side, or an unknown number, isn't compared, unless enforced; one that the
    candidate lacks fails.
    """
    cur = current.select(F.col("bucket"), F.col("sha").alias("cur_sha"), F.col("n").alias("cur_n"), F.col("exact_match").alias("cur_em"))
    overall = F.broadcast(cur.where("bucket = 'all'").drop("bucket", "cur_n"))
    whole = candidate.where("bucket = 'all'").join(overall, F.lit(True), "left")
    first = F.col("cur_em").isNull()
    both = F.col("sha").isNotNull() & (F.col("sha") != "") & F.col("cur_sha").isNotNull() & (F.col("cur_sha") != "")
    models = candidate.select("model").distinct()
    every = models.join(F.broadcast(cur.where("bucket <> 'all'")), F.lit(True))
    met = every.join(candidate.where("bucket <> 'all'").select("model", "bucket", "n", "exact_match"), ["model", "bucket"], "left")
    lacking = F.col("exact_match").isNull()
    small = F.coalesce(F.least("n", "cur_n") < least, F.lit(True))
    fell = F.col("cur_em") - F.col("exact_match") > tolerance / 100 + EPS
    bad = lacking | (fell if enforce_small else ~small & fell)
    regressed = met.groupBy("model").agg(F.array_sort(F.collect_list(F.when(bad, F.col("bucket")))).alias("regressed"))
    known = whole.join(regressed, "model", "left").withColumn("regressed", F.coalesce("regressed", F.array().cast("array<string>")))
    checks: list[tuple[str, Column, Column]] = [
        ("eval_file_match", first | F.coalesce(both & (F.col("sha") == F.col("cur_sha")), F.lit(False)), F.when(first, "first").when(~both, "no sha").otherwise("compared")),
        ("valid_rate", F.coalesce(F.col("valid_rate") + EPS >= min_valid, F.lit(False)), F.when(F.col("valid_rate").isNull(), "no rate").otherwise("compared")),
        ("min_exact_match", F.coalesce(F.col("exact_match") + EPS >= floor, F.lit(False)), F.lit("compared")),
        ("overall_exact_match", first | (F.col("exact_match") - F.col("cur_em") + EPS >= 0), F.when(first, "first").otherwise("compared")),
        ("bucket_regression", first | (F.size("regressed") == 0), F.array_join("regressed", ",")),
    ]
    return known.select("model", F.inline(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("passed"), r.alias("reason")) for n, c, r in checks))))


def decision(checks: DataFrame) -> DataFrame:
    return checks.groupBy("model").agg(F.bool_and("passed").alias("promote"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",").alias("failed"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logs, whole and in order, to states. Held at a time: a batch, and one adapter's stack and status."""
    at, stack, status = None, [], {}

    def rows() -> list[tuple]:
        return [(at, v, s, bool(stack) and v == stack[-1]) for v, s in status.items()]

    def batch_of(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.string(), pa.string(), pa.bool_()), strict=True)], ["adapter", "version", "status", "is_current"])

    kind = None
    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for adapter, action, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if adapter != at:
                out += rows()
                at, stack, status = adapter, [], {}
            if action == "register" and v is not None:
                status.setdefault(v, "registered")
            elif action == "promote" and v in status:
                if stack:
                    status[stack[-1]] = "superseded"
                stack.append(v)
                status[v] = "promoted"
            elif action == "reject" and status.get(v) == "registered":
                status[v] = "rejected"
            elif action == "rollback" and len(stack) > 1:
                status[stack.pop()] = "rolled_back"
                status[stack[-1]] = "promoted"
        yield batch_of(out, kind)
    if kind is not None:
        yield batch_of(rows(), kind)


def states(events: DataFrame) -> DataFrame:
    """(adapter, version, status, is_current): what the log amounts to, folded in order for each adapter.

    events: adapter, at, action (register, promote, reject, rollback), version. Promotion supersedes the current version;
    rollback takes the last promoted one off the stack, if there are two at least, and the one below is current again; rejection
    touches registered versions only. Logs are sorted, not gathered, and folded batch by batch, so a task holds an
    adapter's state but never its log.
    """
    ship(events.sparkSession)
    logs = events.select("adapter", "at", "action", F.col("version").cast("string").alias("version")).repartition("adapter").sortWithinPartitions("adapter", "at", "action", "version")
    kind = events.schema["adapter"].dataType.simpleString()
    return logs.select("adapter", "action", "version").mapInArrow(_fold, f"adapter {kind}, version string, status string, is_current boolean")


def current(events: DataFrame) -> DataFrame:
    """(adapter, version) that resolves now."""
    return states(events).where("is_current").select("adapter", "version")


def next_versions(events: DataFrame) -> DataFrame:
    """(adapter, version) that would be registered next: v0001, v0002, .."""
    last = F.max(F.when(F.col("action") == "register", F.substring("version", 2, 8).cast("int")))
    return events.groupBy("adapter").agg(F.format_string("v%04d", F.coalesce(last, F.lit(0)) + 1).alias("version"))


def history(events: DataFrame) -> DataFrame:
    return events.withColumn("nth", F.row_number().over(Window.partitionBy("adapter").orderBy("at")))


def metric_value(stored: Column) -> Column:
    """A metric as files hold it, a number or an object with value, point or mean; null where it isn't from 0 to 1."""
    number = F.coalesce(*(F.get_json_object(stored, f"$.{k}") for k in ("value", "point", "mean")), F.when(~stored.startswith("{"), stored)).try_cast("double")
    return F.when(number.between(0, 1), number)
