"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints have 64 bits, that is eight positional bytes. Two that differ in at most three bits differ in at most three
bytes, so they share at least five of eight: the guaranteed minimum. Posting lists on single bytes would be long, so the
index posts each distinct fingerprint under sets of positional bytes chosen such that any five shared positions contain a
whole set (a covering design); no link is lost. Each pair that meets in a list is tallied (shared positional bytes), must
reach the minimum, and is verified by its differing bits. The sets grow from three to four or five positions where the lists
would hold too many pairs. Equal fingerprints are one node, so copies are never expanded into pairs.

Components come from repeated hooking and pointer jumping over the links, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import only_rows, row_hash, session, stash, text_bytes

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Bit j (from the high end) of byte value v.
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; zero without words."""
    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)])
    cells = np.frombuffer(raw, np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(cells, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(cells[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "raw", "fp"])

    return run


def covering(size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any five of the eight positions contain one of them.

    Three: the triples within either half, since five positions have three in one half. Otherwise greedily.
    """
    if size == 3:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    left, chosen = set(combinations(range(8), 5)), []
    while left:
        best = max(combinations(range(8), size), key=lambda s: (sum(set(s) <= set(x) for x in left), s))
        chosen.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return chosen


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (56 - 8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _postings(nodes: DataFrame, size: int) -> DataFrame:
    sets = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("v")) for i, s in enumerate(covering(size))))
    return nodes.select("fp", F.explode(sets).alias("k")).select("fp", F.col("k.i").alias("i"), F.col("k.v").alias("v"))


def _shared_bytes(x: Column) -> Column:
    """Positional bytes in which the two fingerprints agree."""
    return sum((F.shiftright(x, 56 - 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints with at most max_bits (three at most) differing bits."""
    minimum = 8 - max_bits
    n = nodes.count()
    for size in (3, 4, 5):
        postings = _postings(nodes, size)
        work = postings.groupBy("i", "v").agg(F.count("*").cast("double").alias("m")).agg(F.sum(F.expr("m * (m - 1) / 2"))).first()[0]
        if size == 5 or (work or 0) <= 32 * n + 1_000_000:
            break
    a, b = (postings.select(F.col("fp").alias(x), F.col("i").alias(f"i{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    met = (F.col("ia") == F.col("ib")) & (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b"))
    counted = (_shared_bytes(differing) >= minimum) & (F.bit_count(differing) <= max_bits)
    return a.join(b, met & counted).select("a", "b").distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, low, root): the smallest `low` among the nodes that can be reached, null only where all are, and one node that stands
    for the component. nodes: fp, low (distinct fp); pairs: a, b.

    A label is a node that can be reached: its low and its fp. Each round takes the least label of a node's neighbours, then
    jumps to the label of that node; the loop ends when a round changes nothing. Only linked nodes take part, and each
    round's table is written to the shared folder.
    """
    both = stash(pairs.union(pairs.select("b", "a")), "links")
    linked = both.select(F.col("a").alias("fp")).distinct()
    labels = stash(nodes.join(linked, "fp").select("fp", F.struct(F.col("low").isNull().alias("none"), "low", "fp").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), F.col("label").alias("there")), "b").groupBy("a").agg(F.min("there").alias("there"))
        hooked = stash(labels.join(near, F.col("fp") == F.col("a")).select("fp", F.col("label").alias("was"), F.least("label", "there").alias("label")), "hooked")
        jump = hooked.select(F.col("fp").alias("at"), F.col("label").alias("to"))
        labels = stash(hooked.join(jump, F.col("label.fp") == F.col("at")).select("fp", "was", F.least("label", "to").alias("label")), "labels")
        if labels.where(F.col("label.fp") != F.col("was.fp")).isEmpty():
            break
        labels = labels.select("fp", "label")
    found = labels.select(F.col("fp").alias("linked"), F.col("label.low").alias("reached"), F.col("label.fp").alias("at"))
    return nodes.join(found, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("reached", "low").alias("low"), F.coalesce("at", "fp").alias("root"))


def _components(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    """doc_id, raw (a hash of the text as it is), fp, low and root of each row."""
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), row_hash(docs, "text").alias("raw"))
    prints = stash(rows.mapInArrow(_fingerprints(width), "doc_id long, raw long, fp long"), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    pairs = stash(links(nodes.select("fp"), max_bits), "pairs")
    return prints.join(components(nodes, pairs), "fp")


def simhash_components(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached).

    Reads doc_id and text; other columns are ignored. A null text counts as empty. Texts without a word have fingerprint zero
    and are linked like any other; fewer words than the shingle's width make one shingle. Rows that repeat an id count once
    as a node. Rows without id are linked like others; component_id is null only where no row of the component has an id. A very
    long text is one fingerprint. An empty table gives no rows.
    """
    found = _components(docs, width, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id; one without id only where all are.

    Of rows that share that id, that whose text has the least hash stays; of rows that share the text too, any one.
    """
    alike = _components(docs, SHINGLE, MAX_BITS).groupBy("root", "doc_id", "raw").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "n"))
    stay = alike.groupBy("root").agg(first.alias("one")).select("one.doc_id", "one.raw", "one.n")
    return only_rows(docs, stash(stay, "near-stay"), "text")
