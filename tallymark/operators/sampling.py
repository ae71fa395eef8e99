"""Seeded samples by hash order: nested prefixes, strata, whole groups."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.plans.ranks import ranked, summed_before


def hash_order(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *keys), 256)


def nested_prefixes(rows: DataFrame, keys: list[str], sizes: list[int], seed: int) -> DataFrame:
    """(keys, pos, size): every smaller sample is part of the larger ones; sizes beyond the rows are left out."""
    order = ranked(rows.select(*keys, hash_order(seed, *keys).alias("__h")), [], ["__h", *keys], "pos", max(sizes))
    total = rows.count()
    wanted = F.array(*(F.lit(s) for s in sizes if s <= total)) if any(s <= total for s in sizes) else F.array().cast("array<int>")
    return order.drop("__h").withColumn("size", F.explode(F.filter(wanted, lambda s: F.col("pos") <= s)))


def stratum_sizes(rows: DataFrame, stratum: str) -> dict[str, int]:
    """Rows of each stratum: a closed, small set."""
    return {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}


def water_fill(sizes: dict[str, int], n: int, order: list[str] | None = None) -> dict[str, int]:
    """Equal shares for all strata that still have rows, again and again, until n are given out."""
    names = [s for s in (order or sorted(sizes)) if sizes.get(s)]
    given, left = dict.fromkeys(names, 0), min(n, sum(sizes[s] for s in names))
    while left:
        waiting = [s for s in names if given[s] < sizes[s]]
        share = max(1, left // len(waiting))
        for s in waiting:
            more = min(share, sizes[s] - given[s], left)
            given[s] += more
            left -= more
    return given


def proportional(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Shares by size, one at least. What is over is taken from the largest shares; what is left goes by largest remainder, one each."""
    total = sum(sizes.values())
    quota = {s: divmod(n * k, total) for s, k in sorted(sizes.items())}
    given = {s: min(sizes[s], whole or 1) for s, (whole, _) in quota.items()}
    over = sum(given.values()) - n
    if over > 0:
        largest = [(-k, s) for s, k in given.items()]
        heapq.heapify(largest)
        for _ in range(over):
            k, s = largest[0]
            heapq.heapreplace(largest, (k + 1, s))
        return {s: -k for k, s in sorted(largest, key=lambda x: x[1])}
    by_remainder = sorted((s for s in quota if given[s] < sizes[s]), key=lambda s: -quota[s][1])
    return given | {s: given[s] + 1 for s in by_remainder[:-over or 0]}


def enriched(sizes: dict[str, int], n: int, whole: str, plain: str) -> dict[str, int]:
    """All of one stratum; the others level-filled up to n in total; and as many plain rows as all these."""
    rest = {s: k for s, k in sizes.items() if s not in (whole, plain)}
    given = {whole: sizes.get(whole, 0), **water_fill(rest, max(0, n - sizes.get(whole, 0)))}
    return {**given, plain: min(sizes.get(plain, 0), sum(given.values()))}


def stratified(rows: DataFrame, stratum: str, keys: list[str], given: dict[str, int], seed: int) -> DataFrame:
    """The first rows of each stratum in hash order, as many as given says."""
    order = ranked(rows.withColumn("__h", hash_order(seed, *keys)), [stratum], ["__h", *keys], "__at", max([0, *given.values()]))
    take = F.coalesce(*(F.when(F.col(stratum) == s, F.lit(k)) for s, k in given.items()), F.lit(0))
    return order.where(F.col("__at") <= take).drop("__h", "__at")


def whole_groups(rows: DataFrame, group: str, at_least: int, seed: int) -> DataFrame:
    """(group, size, before): groups in hash order while fewer than at_least rows come before them."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    return summed_before(sizes, [hash_order(seed, group), group], "before", "size").where(F.col("before") < at_least)


def groups_and_top_up(rows: DataFrame, group: str, stratum: str, keys: list[str], at_least: int, per_stratum: int, seed: int) -> DataFrame:
    """rows of whole groups (part "group"), and of other groups what each stratum lacks (part "topup")."""
    core = whole_groups(rows, group, at_least, seed).select(group)
    first = rows.join(core, group, "left_semi")
    have = {r[0]: r[1] for r in first.groupBy(stratum).count().collect()}
    others = rows.join(core, group, "left_anti")
    need = {s: per_stratum - have.get(s, 0) for s in stratum_sizes(rows, stratum)}
    more = stratified(others, stratum, keys, {s: k for s, k in need.items() if k > 0}, seed) if any(k > 0 for k in need.values()) else others.limit(0)
    return first.withColumn("part", F.lit("group")).unionByName(more.withColumn("part", F.lit("topup")))
