"""Requests and their latency, slot pools and prefix caches, as dataflow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zipf_weights(tenants: int, s: float = 1.1) -> list[float]:
    """Upper ends of the tenants' shares of [0, 1); tenant i has weight (i + 1) ** -s."""
    raw = [(i + 1) ** -s for i in range(tenants)]
    total, out, at = sum(raw), [], 0.0
    for w in raw:
        at += w / total
        out.append(at)
    return out


def uniform(*parts: str | Column, digits: int = 8) -> Column:
    """A number in [0, 1) from a hash of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("double") / float(16**digits)


def assigned_tenant(u: Column, tenants: int, s: float | None = 1.1) -> Column:
    """The tenant of a uniform number: by share under Zipf's law, or evenly without s. The table of shares is a literal."""
    if s is None:
        return F.floor(u * tenants).cast("int")
    ends = F.array(*map(F.lit, zipf_weights(tenants, s)))
    return F.least(F.size(F.filter(ends, lambda e: e <= u)), F.lit(tenants - 1))


def poisson_arrivals(requests: DataFrame, order: str, rate: float, seed: int) -> DataFrame:
    """requests with arrival_s: the running sum of exponential gaps. Gaps are summed by block first, so no task sees them all."""
    gap = -F.log(1 - uniform(F.lit(seed), order)) / rate
    keyed = requests.withColumns({"__gap": gap, "__block": F.floor(F.col(order) / 4096)})
    blocks = keyed.groupBy("__block").agg(F.sum("__gap").alias("__sum"))
    before = blocks.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("__sum")
    inside = F.sum("__gap").over(Window.partitionBy("__block").orderBy(order))
    return keyed.join(before, "__block").withColumn("arrival_s", F.col("__before") + inside).drop("__gap", "__block", "__before")


def lognormal_length(u1: Column, u2: Column, mu: float, sigma: float, low: int, high: int) -> Column:
    """A clipped log-normal length from two uniform numbers."""
    normal = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * F.pi() * u2)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.exp(mu + sigma * normal)).cast("int")))


def latencies(outcomes: DataFrame, ttft_slo: float, tpot_slo: float) -> DataFrame:
    """outcomes (arrival_s, first_token_s, finish_s, n_tokens) with ttft, tpot (null below two tokens), done, within.

    Time to the first token counts from the intended arrival. A request that has not finished is not within its bounds.
    """
    done = F.col("finish_s").isNotNull()
    ttft = F.col("first_token_s") - F.col("arrival_s")
    tpot = F.when(F.col("n_tokens") >= 2, (F.col("finish_s") - F.col("first_token_s")) / (F.col("n_tokens") - 1))
    within = done & (ttft <= ttft_slo) & F.coalesce(tpot <= tpot_slo, F.lit(True))
    return outcomes.withColumns({"ttft": ttft, "tpot": tpot, "done": done, "within": F.coalesce(within, F.lit(False))})


def goodput(timed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completed and attained requests; attainment is over all requests, goodput over the window of arrivals, throughput over the wall."""
    good = F.sum(F.when(F.col("within"), 1).otherwise(0))
    window, wall = F.max("arrival_s") - F.min("arrival_s"), F.max("finish_s") - F.min("arrival_s")
    ends = lambda c, q: F.percentile(c, q)
    return timed.groupBy(*(by or [])).agg(
        F.count("*").alias("requests"), F.sum(F.when(F.col("done"), 1).otherwise(0)).alias("completed"), good.alias("attained"), F.try_divide(good, F.count("*")).alias("attainment"),
        F.try_divide(good.cast("double"), window).alias("goodput"), F.try_divide(F.sum(F.when(F.col("done"), F.col("n_tokens"))).cast("double"), wall).alias("tokens_per_s"),
        ends("ttft", 0.5).alias("ttft_p50"), ends("ttft", 0.99).alias("ttft_p99"), ends("tpot", 0.5).alias("tpot_p50"),
    )


def nearest_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean (one digit), p50 (element n // 2), p99 (element 0.99 (n - 1) cut down), max, sum: by rank, not interpolated.

    Ranks come from counts of distinct values, so a hot group is pre-aggregated.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumns({"__upto": F.sum("__c").over(upto), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col(value)))
    total = F.sum(F.col(value) * F.col("__c"))
    return placed.groupBy(*by).agg(
        F.sum("__c").alias("n"), F.bround(total / F.sum("__c"), 1).alias("mean"), at(F.floor(F.col("__n") / 2)).alias("p50"), at(F.floor(F.lit(0.99) * (F.col("__n") - 1))).alias("p99"),
        F.max(value).alias("max"), total.alias("sum"),
    )


def workload(requests: DataFrame, tenant: str, length: str) -> DataFrame:
    """What a workload turned out as: requests, mean length, tenants, the top tenant's share."""
    per = requests.groupBy(tenant).agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    return per.agg(F.sum("n").alias("requests"), F.try_divide(F.sum("total").cast("double"), F.sum("n")).alias("mean_length"), F.count("*").alias("tenants"), F.try_divide(F.max("n"), F.sum("n")).alias("top_share"))


@dataclass
class Pool:
    """Slots for adapters: a hit refreshes, a miss takes an empty slot or evicts the least recently used one that nobody holds or pins.

    The clock ticks on every acquisition, also on one that has to wait. Releasing doesn't refresh.
    """

    slots: int
    pinned: frozenset[str] = frozenset()
    clock: int = 0
    used: dict[str, int] = field(default_factory=dict)
    held: dict[str, int] = field(default_factory=dict)

    def _victim(self) -> str | None:
        free = [(t, a) for a, t in self.used.items() if not self.held.get(a) and a not in self.pinned]
        return min(free)[1] if free else None

    def can_acquire(self, adapter: str) -> bool:
        return adapter in self.used or len(self.used) < self.slots or self._victim() is not None

    def acquire(self, adapter: str) -> tuple[str, str | None]:
        """(hit, miss, evict or wait; who was evicted)."""
        self.clock += 1
        gone = None
        if adapter not in self.used and len(self.used) >= self.slots:
            gone = self._victim()
            if gone is None:
                return "wait", None
            del self.used[gone]
        outcome = "hit" if adapter in self.used else "evict" if gone else "miss"
        self.used[adapter] = self.clock
        self.held[adapter] = self.held.get(adapter, 0) + 1
        return outcome, gone

    def release(self, adapter: str) -> None:
        if not self.held.get(adapter):
            raise ValueError(f"{adapter} is not held")
        self.held[adapter] -= 1

    def state(self) -> tuple[int, dict[str, int], dict[str, int]]:
        return self.clock, self.used, {a: n for a, n in self.held.items() if n}


POOL_OUTCOME = "pool string, seq long, adapter string, action string, outcome string, evicted string"


def replay(pool: Pool, rows: pd.DataFrame) -> Iterator[tuple]:
    """Outcomes of a pool's actions (acquire, release) in order; releasing what isn't held is told, not raised."""
    for r in rows.sort_values("seq").itertuples():
        if r.action == "acquire":
            outcome, gone = pool.acquire(r.adapter)
        else:
            outcome, gone = ("released" if pool.held.get(r.adapter) else "not_held"), None
            if outcome == "released":
                pool.release(r.adapter)
        yield r.pool, r.seq, r.adapter, r.action, outcome, gone


def pool_outcomes(actions: DataFrame, slots: int, pinned: frozenset[str] = frozenset()) -> DataFrame:
    """Each action with its outcome; pools run side by side. actions: pool, seq, adapter, action.

    A pool's own actions depend on all before them, so a pool is one task's work; the streaming form keeps the state between
    batches instead (`tallymark.streaming.pools`).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(replay(Pool(slots, pinned), rows)), columns=["pool", "seq", "adapter", "action", "outcome", "evicted"])

    return actions.select("pool", "seq", "adapter", "action").groupBy("pool").applyInPandas(run, POOL_OUTCOME)


def pool_statistics(outcomes: DataFrame) -> DataFrame:
    n = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), 1).otherwise(0))
    took = outcomes.where("action = 'acquire'").groupBy("pool")
    return took.agg(F.count("*").alias("acquired"), n("hit").alias("hits"), n("miss", "evict").alias("loads"), n("evict").alias("evictions"), n("wait").alias("waits"), F.try_divide(n("hit"), n("hit", "miss", "evict")).alias("hit_rate"))


def prefix_blocks(tokens: DataFrame, request: str, block: str, payload: str) -> DataFrame:
    """tokens with chain: a hash of all blocks up to this one. Each block's own hash first, so only hashes are carried along."""
    window = Window.partitionBy(request).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    own = tokens.withColumn("__own", F.md5(F.coalesce(payload, F.lit(""))))
    return own.withColumn("chain", F.md5(F.array_join(F.collect_list("__own").over(window), ""))).drop("__own")


def prefix_hits(blocks: DataFrame, request: str, arrival: str, block: str, by: list[str]) -> DataFrame:
    """(request, blocks, hit_blocks): the longest run of blocks from the first that an earlier request of the same namespace had.

    by: what makes the namespace, e.g. the adapter; without it, keys are tokens only, which the audit finds.
    """
    first = blocks.groupBy(*by, "chain").agg(F.min(arrival).alias("__first"))
    seen = blocks.join(first, [*by, "chain"]).withColumn("__hit", F.col("__first") < F.col(arrival))
    return seen.groupBy(request).agg(F.count("*").alias("blocks"), F.coalesce(F.min(F.when(~F.col("__hit"), F.col(block))), F.max(block) + 1).alias("__stop"), F.min(block).alias("__from")).select(request, "blocks", (F.col("__stop") - F.col("__from")).alias("hit_blocks"))


def cross_audit(blocks: DataFrame, namespace: str) -> DataFrame:
    """Prefixes that more than one namespace holds: a cache keyed by tokens alone would mix them."""
    return blocks.groupBy("chain").agg(F.count_distinct(namespace).alias("namespaces"), F.count("*").alias("blocks")).where("namespaces > 1")


def batch_rows(sequences: DataFrame, batch: list[str], order: str, queries: str) -> DataFrame:
    """One row per query token: its sequence, its slot, and its row in the batch (a running offset)."""
    before = F.coalesce(F.sum(queries).over(Window.partitionBy(*batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sequences.withColumn("__before", before).where(F.col(queries) > 0)
    return placed.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col(queries) - 1))).withColumn("row", (F.col("__before") + F.col("__k")).cast("long")).drop("__before", "__k")


def overhead(arms: DataFrame, base: str) -> DataFrame:
    """(arm, median, low, high, overhead_pct) of arms' measurements against a base arm."""
    per = arms.groupBy("arm").agg(F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))
    against = F.broadcast(per.where(F.col("arm") == base).select(F.col("median").alias("__base")))
    return per.join(against, F.lit(True)).select("arm", "median", "low", "high", (100 * F.try_divide(F.col("median") - F.col("__base"), F.col("__base"))).alias("overhead_pct"))


def capacity(shapes: DataFrame, memory: float, share: float = 0.9) -> DataFrame:
    """shapes (base_bytes, adapter_bytes, kv_bytes): merged copies, and adapters beside one base, that fit."""
    room = F.lit(memory * share)
    return shapes.withColumns({
        "merged": F.floor(room / (F.col("base_bytes") + F.col("kv_bytes"))).cast("long"),
        "resident": F.greatest(F.lit(0), F.floor((room - F.col("base_bytes")) / (F.col("adapter_bytes") + F.col("kv_bytes")))).cast("long"),
    })


def lora_parameters(layers: DataFrame, rank: int) -> DataFrame:
    """layers (module, n_in, n_out, copies): parameters of adapters, of the base, and bytes of training either."""
    p = F.sum(F.lit(rank) * (F.col("n_in") + F.col("n_out")) * F.col("copies"))
    n = F.sum(F.col("n_in") * F.col("n_out") * F.col("copies"))
    return layers.agg(p.alias("trainable"), n.alias("total")).withColumns({"full_bytes": 16 * F.col("total"), "lora_bytes": 2 * F.col("total") + 16 * F.col("trainable")})


def routing_faults(recorded: DataFrame, batch: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """keys, expected, recorded: rows whose recorded slot isn't the batch's, or that only one of them has."""
    both = recorded.select(*keys, F.col(slot).alias("recorded")).join(batch.select(*keys, F.col(slot).alias("expected")), keys, "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("recorded"))).select(*keys, "expected", "recorded")


def token_gaps(tokens: DataFrame, request: str, at: str, by: list[str]) -> DataFrame:
    """by, n, p50, p99: percentiles of the time between a request's tokens."""
    gaps = tokens.withColumn("__gap", F.col(at) - F.lag(at).over(Window.partitionBy(request).orderBy(at))).where("__gap is not null")
    return gaps.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("__gap", 0.5).alias("p50"), F.percentile("__gap", 0.99).alias("p99"))


def adapter_key(name: Column) -> Column:
    """layer, module and side of a low-rank weight's name, as base_model.model.model.layers.3.self_attn.q_proj.lora_A.weight; null for other names."""
    part = lambda i: F.regexp_extract(name, r"layers\.(\d+)\.(?:[a-z_]+\.)*?([a-z]+_proj)\.lora_([AB])\.", i)
    return F.when(part(3) != "", F.struct(part(1).cast("int").alias("layer"), part(2).alias("module"), part(3).alias("side")))
