"""SimHash near-dedup at a similarity of 0.8, with fingerprints of 512 bits in the same kind of byte-position index.

64 bits can't tell a similarity of 0.8: texts that share 80 % of their five-word shingles differ in 6 to 10 of them. Here a
fingerprint has 64 positional bytes, from the distinct shingles of five words; a tie takes the bit of the least shingle. The share
of differing bits estimates the angle between the two sets of shingles, so the similarity is their cosine,
shared / sqrt(one * other), which is never below Jaccard's. It is estimated to 0.03 (standard deviation at 0.8).

The index posts each distinct text under 21 sets of three byte positions. In each set the three bits nearest to a tie are the
likeliest to differ in a copy, so the text is posted under all eight values that these three can give: two texts meet in a set
if they differ there only in weak bits of either. A pair that meets once is verified by its differing bits. Differing bits have no
bound here that would guarantee a number of shared bytes, so the index is an approximate one, of which the tests measure the recall;
every text is indexed whole.

A posting also carries 88 further bits and the number of shingles (in steps of 1.25), so that pairs which chance brings together
are left out. The postings that have company in their list are then read again, with the fingerprints, and verified where they
meet. Two readings of some lists compare with one member only and bring large groups together. The last goes through all lists
whose members are still in different components: what is outside of the largest is compared with all others, and one link for
each two components of a list is given out. So a group of near copies is never expanded into its pairs, and no meeting is lost: each
pair that meets is verified, or is in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import only_rows, row_hash, session, stash, text_bytes
from tallymark.llm.simhash import SEED, components

WIDTH, SIMILARITY = 5, 0.8
LANES = 8
SETS, BYTES, WEAK = 21, 3, 3
#: Lists up to BLOCK are compared pair by pair in the first reading; all postings of a longer one have company.
BLOCK = 32
#: Further bits: the last three bytes and a lane that a set has no byte of, one for the sets before LANE_SETS and one for the others.
SKETCH, LANE_SETS, LATE, EARLY = 88, 11, 5, 1
_FEATURES = 30
_POSTINGS_A_TASK, _PAIRS_AT_ONCE, _LINKS_A_TASK = 1_000_000, 1 << 20, 1 << 18
#: The first two readings compare with one member a list, in lists of one set in FEW: the last one reads all lists, of what is then apart.
FEW = 7
_GOLDEN = 0x9E3779B97F4A7C15
_PRINT = "doc_id long, raw long, words binary, size int, weak binary, " + ", ".join(f"f{k} long" for k in range(LANES))


def max_bits(similarity: float = SIMILARITY) -> int:
    """Differing bits of the angle whose cosine is the similarity, and one standard deviation more, so that most pairs at it pass."""
    n, share = 64 * LANES, math.acos(similarity) / math.pi
    return int(n * share + math.sqrt(n * share * (1 - share)))


def _reach(similarity: float) -> tuple[int, int]:
    """How far two postings of a pair may differ: steps of size; further bits, three standard deviations over those at the limit."""
    share = max_bits(similarity) / (64 * LANES)
    return math.ceil(2 * math.log(1 / similarity) / math.log(1.25) - 1e-9), int(SKETCH * share + 3 * math.sqrt(SKETCH * share * (1 - share)))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than the width make one."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts, last, digest = [0, *(e + 1 for e in ends[:-1])], ends[min(width, len(words)) - 1 :], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last)))


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """512 bits for each hash, by a finaliser over the hash and each lane's number."""
    z = hashes[:, None] + np.array([k * _GOLDEN % (1 << 64) for k in range(1, LANES + 1)], np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unpackbits((z ^ (z >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(len(hashes), 8 * LANES), axis=1)


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each of the 512 bits, twice the shingles that set it less their number, with ties broken to one side."""
    out = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 4096):
        out += _lanes(hashes[at : at + 4096]).sum(0, dtype=np.int64)
    out = 4 * out - 2 * len(hashes)
    return out + np.where(_lanes(hashes[:1])[0] == 1, 1, -1) if len(hashes) else out - 1


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower().split() for t in batch.column(1).to_pylist()]
            sets = [shingles(w, width) for w in texts]
            n = len(sets)
            if n == 0:
                continue
            tally = np.array([votes(s) for s in sets])
            lanes = np.packbits(tally > 0, axis=1).view("<u8").astype(np.int64)
            margins = np.abs(tally[:, : SETS * BYTES * 8]).reshape(n, SETS, BYTES * 8)
            weak = np.argsort(margins, axis=2, kind="stable")[:, :, :WEAK].astype(np.uint8).reshape(n, SETS * WEAK)
            columns = [
                batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in texts], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()), pa.array([w.tobytes() for w in weak], pa.binary()),
                *(pa.array(lanes[:, k]) for k in range(LANES)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "words", "size", "weak", *(f"f{k}" for k in range(LANES))])

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, more, node): k holds the set of positions and the value of their bytes, then features that chance pairs fail on, as does more."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        lanes = np.stack([batch.column(3 + k).to_numpy() for k in range(LANES)], axis=1)
        cells = np.ascontiguousarray(lanes).view(np.uint8).reshape(n, 8 * LANES).astype(np.int64)
        value = np.zeros((n, SETS), np.int64)
        for j in range(BYTES):
            value = value << 8 | cells[:, j : SETS * BYTES : BYTES]
        at = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, SETS, WEAK).astype(np.int64)
        bits = np.int64(1) << (BYTES * 8 - 1 - at)
        flips = np.zeros((n, SETS, 1), np.int64)
        for j in range(WEAK):
            flips = np.concatenate([flips, flips | bits[:, :, j : j + 1]], axis=2)
        keys = np.arange(SETS, dtype=np.int64)[None, :, None] << BYTES * 8 | (value[:, :, None] ^ flips)
        size = np.maximum(batch.column(1).to_numpy(), 1)
        steps = np.minimum(np.floor(np.log(size) / np.log(1.25) + 1e-9), 63).astype(np.int64)
        features = (cells[:, -3] << 16 | cells[:, -2] << 8 | cells[:, -1]) << 6 | steps
        k = keys << _FEATURES | features[:, None, None]
        early = (np.arange(SETS) < LANE_SETS)[None, :, None]
        more = np.broadcast_to(np.where(early, lanes[:, LATE, None, None], lanes[:, EARLY, None, None]), k.shape)
        node = np.broadcast_to(batch.column(0).to_numpy()[:, None, None], k.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).ravel()) for x in (k, more, node)], ["k", "more", "node"])


def _plausible(k: np.ndarray, more: np.ndarray, other_k: np.ndarray, other_more: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    steps, bits = reach
    apart = np.bitwise_count((k ^ other_k) & ((1 << 24) - 1) << 6).astype(np.int16) + np.bitwise_count((more ^ other_more).view(np.uint64))
    return (apart <= bits) & (np.abs((k & 63) - (other_k & 63)) <= steps)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def _meet(reach: tuple[int, int]):
    """Of postings sorted by list, those that may have a partner there."""

    def found(cols: list[np.ndarray], goes_on: bool) -> pa.RecordBatch:
        """Of whole lists, but for a long one that the first rows go on with or the last rows begin."""
        k, more, _ = cols
        key = k >> _FEATURES
        starts = _starts(key)
        length = np.diff(np.concatenate((starts, [len(key)])))
        home = np.repeat(np.arange(len(starts)), length)
        company = (length > BLOCK)[home]
        if goes_on:
            company[home == 0] = True
        for apart in range(1, min(BLOCK, len(k))):
            same = np.flatnonzero((home[apart:] == home[:-apart]) & ~(company[apart:] & company[:-apart]))
            if not len(same):
                break
            same = same[_plausible(k[same], more[same], k[same + apart], more[same + apart], reach)]
            company[same] = company[same + apart] = True
        return pa.RecordBatch.from_arrays([pa.array(x[company]) for x in cols], ["k", "more", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, long = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            cols = [np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(cols)]
            if len(cols[0]) < 16 * BLOCK:
                continue
            key = cols[0] >> _FEATURES
            done, goes_on = int(np.searchsorted(key, key[-1])), long == key[0]
            if goes_on and done == 0 or len(key) - done > BLOCK:  # what follows of a long list has company, whatever it is
                yield found(cols, goes_on)
                cols, long = [x[:0] for x in cols], key[-1]
            else:
                yield found([x[:done] for x in cols], goes_on)
                cols, long = [x[done:] for x in cols], None
        if len(cols[0]):
            yield found(cols, long == cols[0][0] >> _FEATURES)

    return run


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """k, more, node, root and fingerprint of whole lists, one or many at a time."""
    parts: list[list[np.ndarray]] = []

    def join() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        cols.append(np.stack([batch.column(4 + i).to_numpy() for i in range(LANES)], axis=1).view(np.uint64))
        if not len(cols[0]):
            continue
        key = cols[0] >> _FEATURES
        done = int(np.searchsorted(key, key[-1]))
        if done or parts and parts[-1][0][-1] >> _FEATURES != key[0]:
            parts.append([x[:done] for x in cols])
            yield join()
            parts = []
        parts.append([x[done:] for x in cols])
    if parts:
        yield join()


def _near(prints: np.ndarray, others: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(prints ^ others).sum(axis=1, dtype=np.int64) <= limit


def _first(reach: tuple[int, int], limit: int):
    """Links (a, b) to the first member of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, more, node, _, prints in _whole_lists(batches):
            starts = _starts(k >> _FEATURES)
            lead = np.repeat(starts, np.diff(np.concatenate((starts, [len(k)]))))
            b = np.flatnonzero((node != node[lead]) & _plausible(k, more, k[lead], more[lead], reach))
            b = b[_near(prints[b], prints[lead[b]], limit)]
            links = np.unique(np.stack((node[lead[b]], node[b]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def _mixed(reach: tuple[int, int], limit: int, lead_only: bool):
    """Links (a, b) of lists with members in different components, one for each two components of a list.

    What is outside of the list's largest component is compared with one member of that (lead_only), or with all others.
    """

    def of_list(k: np.ndarray, more: np.ndarray, node: np.ndarray, root: np.ndarray, prints: np.ndarray) -> Iterator[np.ndarray]:
        _, at, n = np.unique(root, return_inverse=True, return_counts=True)
        within = at == n.argmax()
        others, against = np.flatnonzero(~within), np.arange(len(k))
        if lead_only:  # another than the first member, the same in most lists
            here = np.flatnonzero(within)
            against = here[[(node[here].view(np.uint64) * np.uint64(_GOLDEN)).argmin()]]
        rows = max(1, _PAIRS_AT_ONCE // len(against))
        for i in range(0, len(others), rows):
            o = others[i : i + rows, None]
            a, b = np.nonzero((at[o] != at[against]) & (within[against] | (o < against)) & _plausible(k[o], more[o], k[against], more[against], reach))
            a, b = others[i + a], against[b]
            near = np.concatenate([_near(prints[a[x : x + 65536]], prints[b[x : x + 65536]], limit) for x in range(0, max(1, len(a)), 65536)])
            a, b = a[near], b[near]
            _, one = np.unique(np.stack((at[a], at[b]), axis=1), axis=0, return_index=True)
            yield np.stack((node[a[one]], node[b[one]]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_lists(batches):
            starts = _starts(cols[0] >> _FEATURES)
            ends = np.concatenate((starts[1:], [len(cols[0])]))
            mixed = np.flatnonzero(np.minimum.reduceat(cols[3], starts) != np.maximum.reduceat(cols[3], starts)).tolist()
            links = [x for i in mixed for x in of_list(*(c[starts[i] : ends[i]] for c in cols))]
            if links:
                found = np.unique(np.concatenate(links), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _key(k: str = "k") -> Column:
    return F.shiftright(k, _FEATURES)


def _across(lists: DataFrame, tasks: int, roots: DataFrame | None, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], few: bool) -> DataFrame:
    """Links that a reading of the lists finds, between members of different components if there are roots."""
    rooted = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots.select(F.col("fp").alias("node"), "root"), "node")
    members = rooted.select("node", "root", F.inline("at"), *(f"f{k}" for k in range(LANES)))
    if few:
        members = members.where(F.shiftright("k", _FEATURES + 8 * BYTES) % FEW == 0)
    dealt = members.select("k", "more", "node", "root", *(f"f{k}" for k in range(LANES))).repartition(tasks, _key())
    return dealt.sortWithinPartitions(_key(), "node").mapInArrow(run, "a long, b long").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links, one from each node to the node that stands for its component there."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (x := top(a)) != (y := top(b)):
                up[max(x, y)] = min(x, y)
    out = [(a, b) for b in list(up) if (a := top(b)) != b]
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def _thinned(links: DataFrame) -> DataFrame:
    """Links that reach as far, about one for each node and task."""
    return stash(links.repartition(links.count() // _LINKS_A_TASK + 1).mapInArrow(_forest, "a long, b long"), "wide-forest")


def _grouped(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, raw, words), and distinct texts (words, one, root): one is the text's row that would stay."""
    session(docs)
    limit, reach = max_bits(similarity), _reach(similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), row_hash(docs, "text").alias("raw"))
    prints = stash(rows.mapInArrow(_prints(width), _PRINT), "wide-prints")
    carried = ["size", "weak", *(f"f{k}" for k in range(LANES))]
    alike = prints.groupBy("words", "doc_id", "raw").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in carried))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "n")).alias("one")
    distinct = alike.groupBy("words").agg(first, *(F.first(c).alias(c) for c in carried))
    nodes = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    postings = nodes.select("node", "size", "weak", *(f"f{k}" for k in range(LANES))).mapInArrow(_post, "k long, more long, node long")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffles, nodes.count() * SETS * 2**WEAK // _POSTINGS_A_TASK)
    met = postings.repartition(tasks, _key()).sortWithinPartitions(_key(), "node").mapInArrow(_meet(reach), "k long, more long, node long")
    lanes = [f"f{k}" for k in range(LANES)]
    kept = met.groupBy("node").agg(F.collect_list(F.struct("k", "more")).alias("at"))
    lists = stash(kept.join(nodes.select("node", *lanes), "node"), "wide-lists")
    tasks = max(shuffles, (lists.agg(F.sum(F.size("at"))).first()[0] or 0) // _POSTINGS_A_TASK)
    ids = nodes.select(F.col("node").alias("fp"), F.col("one.doc_id").alias("low"))
    links = stash(_across(lists, tasks, None, _first(reach, limit), True), "wide-links")
    links = _thinned(links)
    roots = stash(components(ids, links), "wide-roots")
    for lead_only in (True, False):
        more = stash(_across(lists, tasks, roots, _mixed(reach, limit, lead_only), lead_only), "wide-more")
        if not more.isEmpty():
            links = _thinned(links.union(more))
            roots = stash(components(ids, links), "wide-roots")
    named = roots.select(F.col("fp").alias("node"), "root", "low")
    return prints.select("doc_id", "raw", "words"), nodes.select("node", "words", "one").join(named, "node").drop("node")


def near_components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest doc_id that can be reached over links of that similarity).

    Reads doc_id and text; other columns are ignored. Texts with the same words, A-Z lower-cased, are one text. A null text counts as
    empty; texts without a word are one text and link to no other. Fewer words than the width make one shingle. Rows that repeat an id
    or have none are linked each by its text; component_id is null only where no row of the component has an id. Very long texts
    are read in blocks of shingles. An empty table gives no rows.
    """
    rows, texts = _grouped(docs, width, similarity)
    return rows.join(texts.select("words", F.col("low").alias("component_id")), "words").select("doc_id", "component_id")


def kept_rows(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id; one without id only where all are.

    Of rows that share that id, that whose text has the least hash stays; of rows that share the text too, any one.
    """
    _, texts = _grouped(docs, width, similarity)
    stay = texts.groupBy("root").agg(F.min("one").alias("one")).select("one.doc_id", "one.raw", "one.n")
    return only_rows(docs, stash(stay, "wide-stay"), "text")
