"""Sharding by k-d tree, in DataFrame functions alone.

A node of the tree has a number of leaves to make. One with k leaves is split into k // 2 and the rest, at the matching
weighted quantile (the weighted median for even k) of its widest metadata dimension; weights are document sizes. Quantiles
come from distributed histograms that zoom in: each round counts the bytes in BINS equal bins between the bounds known so far,
for all nodes of a level at once, until the bin that holds the quantile is one row or one point. The driver sees
SHARDS * BINS counts at most; rows are aggregated map-side and never gathered, whatever their ties.

The dimensions (log size, language, bytes per character) are functions of a document's text and language. Within a dimension
rows are ordered by its value, then a hash of the text, then a hash of the id and of the row's place in the input: copies of a text
stay together, unless a cut must part them to keep sizes equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm._shared import stash

SHARDS, BINS, ROW_BYTES = 40, 4096, 16
#: Rows that one slot counter numbers.
SLOT_ROWS = 20_000
#: Bits of a dimension's value and of the text's hash, which make one ordered point.
VALUE_BITS, HASH_BITS = 20, 42
DIMENSIONS = ("k0", "k1", "k2")
TOP = 1 << (VALUE_BITS + HASH_BITS)


@dataclass
class Node:
    """shard: the first of its leaves. A split takes the rows up to `cut` (point, id hash; both included) below."""

    shard: int
    leaves: int
    dimension: str = DIMENSIONS[0]
    cut: tuple[int, int] = (-1, 0)


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small literal table: one row for each node, so the number of shards bounds it."""
    cells = ",".join("(" + ",".join(f"'{x}'" if isinstance(x, str) else f"CAST({x} AS BIGINT)" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {cells} AS t({names})"))


def _point() -> Column:
    """A row's value on the node's dimension, then the text's hash."""
    value = F.when(F.col("dim") == "k0", F.col("k0")).when(F.col("dim") == "k1", F.col("k1")).otherwise(F.col("k2"))
    return F.shiftleft(value.cast("long"), HASH_BITS).bitwiseOR(F.col("h"))


def _zoom(rows: DataFrame, bounds: dict[int, tuple[int, int]], goals: dict[int, float], below: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each node the one value of `v` where the running bytes reach its goal: (value, rows of it, their bytes).

    rows: n, v (long), size. bounds: inclusive. below: bytes under the bounds, brought up to date.
    """
    done: dict[int, tuple[int, int, int]] = {}
    while bounds:
        steps = _values(rows.sparkSession, "n, lo, hi, st", [(n, a, z, -(-(z - a + 1) // BINS)) for n, (a, z) in bounds.items()])
        inside = rows.join(steps, "n").where("v between lo and hi")
        counted = inside.groupBy("n", F.expr("(v - lo) div st").alias("bin")).agg(F.sum("size").alias("b"), F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        per: dict[int, list] = {n: [] for n in bounds}
        for r in counted.collect():
            per[r["n"]].append(r)
        bounds = {}
        for n, bins in per.items():
            bins.sort(key=lambda r: r["bin"])
            for r in bins:
                if below[n] + r["b"] >= goals[n] or r is bins[-1]:
                    if r["a"] == r["z"]:
                        done[n] = (r["a"], r["c"], r["b"])
                    else:
                        bounds[n] = (r["a"], r["z"])
                    break
                below[n] += r["b"]
    return done


def _cut(rows: DataFrame, nodes: list[Node]) -> None:
    """Give each node, all of more than one leaf, its dimension and cut. rows: n (the node's number), k0.., h, i, size."""
    spark = rows.sparkSession
    ends = [f(d).alias(f"{d}{e}") for d in DIMENSIONS for f, e in ((F.min, "a"), (F.max, "z"))]
    facts = {r["n"]: r for r in rows.groupBy("n").agg(F.sum("size").alias("b"), *(F.stddev_pop(d).alias(d) for d in DIMENSIONS), *ends).collect()}
    whole = rows.agg(*(F.stddev_pop(d).alias(d) for d in DIMENSIONS)).first()
    nodes = [e for e in nodes if e.shard in facts]
    for e in nodes:
        width = {d: (facts[e.shard][d] or 0.0) / (whole[d] or 1.0) for d in DIMENSIONS}
        e.dimension = max(DIMENSIONS, key=lambda d: (width[d], -DIMENSIONS.index(d)))
    if not nodes:
        return
    goals = {e.shard: facts[e.shard]["b"] * (e.leaves // 2) / e.leaves for e in nodes}
    below = dict.fromkeys(goals, 0)
    v = rows.join(_values(spark, "n, dim", [(e.shard, e.dimension) for e in nodes]), "n").select("n", "i", "size", _point().alias("v"))
    bounds = {e.shard: (facts[e.shard][f"{e.dimension}a"] << HASH_BITS, ((facts[e.shard][f"{e.dimension}z"] + 1) << HASH_BITS) - 1) for e in nodes}
    points = _zoom(v, bounds, goals, below)
    tied = {n: p[0] for n, p in points.items() if p[1] > 1}
    last = {}
    if tied:
        at = _values(spark, "n, at", [*tied.items()])
        last = _zoom(v.join(at, "n").where("v = at").select("n", "size", F.col("i").alias("v")), dict.fromkeys(tied, (0, TOP - 1)), goals, below)
    for e in nodes:
        n = e.shard
        ended, b = (last[n][0], last[n][2]) if n in tied else (TOP, points[n][2])
        takes = below[n] + b - goals[n] <= goals[n] - below[n]
        e.cut = (points[n][0], ended if takes else (ended - 1 if n in tied else -1))


def _place(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """rows with n moved on to the part in which they lie."""
    cuts = _values(rows.sparkSession, "n, dim, point, last, up", [(e.shard, e.dimension, *e.cut, e.shard + e.leaves // 2) for e in nodes])
    point = _point()
    below = (point < F.col("point")) | ((point == F.col("point")) & (F.col("i") <= F.col("last")))
    moved = rows.join(cuts, "n", "left").withColumn("n", F.when(F.col("point").isNull() | below, F.col("n")).otherwise(F.col("up")))
    return moved.select(*rows.columns)


def k_d_tree(rows: DataFrame, shards: int) -> DataFrame:
    """rows (k0.., h, i, size) with n, their shard. Each of log2(shards) levels is a lookup in a literal table, then written."""
    placed, ends = rows.withColumn("n", F.lit(0).cast("long")), [Node(0, shards)]
    while todo := [e for e in ends if e.leaves > 1]:
        _cut(placed.join(_values(rows.sparkSession, "n", [(e.shard,) for e in todo]), "n"), todo)
        placed = stash(_place(placed, todo), "shard-level")
        ends = [Node(n, k) for e in ends for n, k in ((e.shard, e.leaves // 2), (e.shard + e.leaves // 2, e.leaves - e.leaves // 2)) if k]
    return placed


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Reads doc_id, text, and lang where there; other columns are ignored. Sizes are UTF-8 bytes plus 16; a null text counts as
    empty. Sizes of shards differ by about one document: each cut takes the row at the quantile to the nearer side. Rows that
    repeat id and text are parted like other copies. A very long text may be more than a shard's share. Slots number a shard's rows from 0 without gaps. An empty table
    gives no rows; with fewer rows than shards some shards stay empty.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    cap = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), lang.alias("l"))
    known = base.select(
        "doc_id",
        (F.octet_length("t") + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        F.floor(F.log(F.octet_length("t") + 1.0) * (1 << 14)).cast("int").alias("k0"),
        (cap(F.ascii("l"), 1023) * 1024 + cap(F.ascii(F.substring("l", 2, 1)), 1023)).cast("int").alias("k1"),
        cap(F.floor((F.octet_length("t") / F.greatest(F.char_length("t"), F.lit(1)) - 1) * (1 << 16)), (1 << VALUE_BITS) - 1).cast("int").alias("k2"),
        F.shiftrightunsigned(F.xxhash64("t"), 64 - HASH_BITS).alias("h"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 2).alias("i"),
    )
    rows = stash(known, "shard-points")
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = k_d_tree(rows, shards).select("doc_id", "size", "text_crc32", F.col("n").cast("int").alias("shard"), F.pmod("i", F.lit(parts)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("c"))
    first = counts.select("shard", "part", (F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")).alias("first"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")))
    return numbered.join(first, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
