"""Streaming forms: slot pools with kept state, resumption, append-only metric logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymark.operators.serving import POOL_OUTCOME, Pool, replay
from tallymark.plans.shipping import ship

STATE = "body string"


def pool_stream(actions: DataFrame, slots: int, pinned: frozenset[str] = frozenset()) -> DataFrame:
    """Outcomes of a stream of pool actions (pool, seq, adapter, action), with slots, holders and clock kept between batches.

    Within a batch a pool's actions are replayed by seq; a pool's batches must come in order. The result is that of
    `tallymark.operators.serving.pool_outcomes` on all actions at once.
    """
    ship(actions.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = Pool(slots, pinned)
        if state.exists:
            pool.clock, pool.used, pool.held = json.loads(state.get[0])
        rows = pd.concat(list(batches))
        out = list(replay(pool, rows))
        state.update((json.dumps([pool.clock, pool.used, pool.held]),))
        yield pd.DataFrame(out, columns=["pool", "seq", "adapter", "action", "outcome", "evicted"])

    return actions.select("pool", "seq", "adapter", "action").groupBy("pool").applyInPandasWithState(run, POOL_OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def fresh_only(records: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Records whose key has not been met within the watermark. time may be a timestamp without zone."""
    timed = records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def windowed_goodput(timed: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Requests, attained ones and their share by event-time window; late data is taken up to the watermark."""
    events = timed.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    good = F.sum(F.when(F.col("within"), 1).otherwise(0))
    return events.groupBy(F.window(time, width).alias("window")).agg(F.count("*").alias("requests"), good.alias("attained"))


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """Start an append-only sink that takes what is there and ends."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
