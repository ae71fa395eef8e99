"""Line dedup by an exact set-similarity join over all lines of a corpus.

A line is the set of its words (ASCII letters lower-cased, other ASCII but digits as blanks). Words are ordered by rarity: by
how often their hash bucket occurs in the whole corpus (2^22 buckets, a byte each, so the order fits any task), then by
hash. Two lines of Jaccard at least 4/5 share a word among the first few of either, so each class of equal lines is posted
under its prefix words. Postings travel in compressed blocks, one for each bucket of words and flush of a map task. Where they
meet, the length filter, the positional filter and a sketch filter (each word flips one of 128 bits; lines whose sketches differ
in too many bits have too many different words) leave few pairs, and these are verified on their words.

A line goes when an equal or similar line comes earlier, by (doc_id, line number). For that one earlier match is enough, so
a bucket emits the earliest candidate of each class and never all pairs; the few classes whose candidates all fail the
verification come again with all of theirs. Words that are so common that their list would not fit a task are dealt in cells:
the list's classes are hashed into groups, and each pair of groups meets in a cell of its own.

Equality of words is that of 64-bit hashes, equality of lines that of 128 bits (a sum over the words and half the sketch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import session, stash, text_bytes

BUCKET_BITS, SLICE_BYTES, SEEN_CLASSES = 22, 1 << 18, 1 << 20
#: Words that a task gathers before it adds them to its counts.
COUNT_WORDS = 1 << 21
#: Postings of a bucket on average, and those that a map task gathers before it sends them.
POSTINGS, FLUSH = 1 << 16, 1 << 20
#: Postings of a word beyond which its list is dealt in cells of two groups of this size.
BLOCK = 1 << 15
#: Pairs that are filtered at a time.
PAIRS = 1 << 19
#: Rows (a few numbers each) that may be sent to all tasks; more are joined by a shuffle, or the filter they serve is left out.
BROADCAST_ROWS = 200_000
_TABLE = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz\n" or c > 0x7F else 0x20 for c in bytes(range(256)).lower())
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
_CLASS = ["ck", "sa"]
_LINE = "doc_id long, h long, line int, n int, ck long, sa long, sb long, skip int, prefix array<int>"
_NO_ID = (1 << 63) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (_P, _P_INVERSE)]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Line number and hash of each word. data: lower-cased words between blanks and line feeds."""
    a = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], a > 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(a) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], dtype=np.uint64)))
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lines = np.searchsorted(np.flatnonzero(a == 10), starts)
    return lines, hashes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """doc_id, row hash and number of each line of a slice, and its bytes; long documents are cut between lines."""
    heads: list[tuple[int, int, int, int]] = []
    parts: list[bytes] = []
    held = 0

    def slice_() -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        ids, hs, first, n = (np.array(x, np.int64) for x in zip(*heads, strict=True))
        start = np.cumsum(n) - n
        numbers = np.arange(n.sum()) - np.repeat(start - first, n)
        return np.repeat(ids, n), np.repeat(hs, n), numbers.astype(np.int32), b"\n".join(parts)

    for batch in batches:
        for doc_id, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data, at, line = text.translate(_TABLE), 0, 0
            while at <= len(data):
                end = len(data) if len(data) - at <= SLICE_BYTES else data.find(b"\n", at + SLICE_BYTES)
                end = len(data) if end < 0 else end
                part = data[at:end]
                n = part.count(b"\n") + 1
                heads.append((doc_id, h, line, n))
                parts.append(part)
                held, at, line = held + len(part) + 1, end + 1, line + n
                if held > SLICE_BYTES:
                    yield slice_()
                    heads, parts, held = [], [], 0
    if parts:
        yield slice_()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, held, words = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
    for *_, data in _slices(batches):
        held.append((word_hashes(data)[1] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        words += len(held[-1])
        if words > COUNT_WORDS:
            counts += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
            held, words = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])


class Lines:
    """Sets of lines: each word once, rarest first. level: a byte for each hash bucket, 1 for a bucket met once."""

    def __init__(self, level: np.ndarray, data: bytes) -> None:
        line, h = word_hashes(data)
        rank = level[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        order = np.argsort(line.astype(np.uint64) << np.uint64(44) | rank.astype(np.uint64) << np.uint64(36) | h >> np.uint64(28))
        line, h, rank = line[order], h[order], rank[order]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.line, self.h, self.rank = line[new], h[new], rank[new]
        self.starts = np.flatnonzero(np.concatenate(([True], self.line[1:] != self.line[:-1]))) if len(self.h) else np.zeros(0, np.int64)
        self.lines, self.n = self.line[self.starts], np.diff(np.concatenate((self.starts, [len(self.h)])))
        if len(self.lines):
            bit = np.uint64(1) << (self.h & np.uint64(63))
            low = (self.h & np.uint64(64)) == 0
            self.ck = np.add.reduceat(_mix(self.h ^ _P), self.starts)
            self.sa = np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), self.starts)
            self.sb = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), self.starts)


def _prefixes(level: np.ndarray):
    """All lines with words; those of a class at the earliest place that the task has met with their prefix words.

    skip: words before the prefix words, which occur once in the corpus and can't be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for ids, hs, numbers, data in _slices(batches):
            sets = Lines(level, data)
            if not len(sets.lines):
                continue
            at = sets.lines
            posted = np.zeros(len(at), bool)
            for i, (ck, place) in enumerate(zip(sets.ck.tolist(), zip(ids[at].tolist(), numbers[at].tolist(), strict=True), strict=True)):
                if (met := seen.get(ck)) is None or place < met:
                    seen[ck] = place
                    posted[i] = True
            if len(seen) > SEEN_CLASSES:
                seen.clear()
            once = np.add.reduceat(sets.rank <= 1, sets.starts)
            size = np.where(posted, sets.n - -(-4 * sets.n // 5) + 1, 0)
            skip = np.minimum(once, size)
            size = size - skip
            offsets = np.concatenate(([0], np.cumsum(size)))
            words = sets.h[np.repeat(sets.starts + skip - offsets[:-1], size) + np.arange(offsets[-1])] >> np.uint64(32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words.astype(np.uint32).view(np.int32)))
            numbers_ = [sets.ck, sets.sa, sets.sb]
            arrays = [ids[at], hs[at], numbers[at], sets.n.astype(np.int32), *(x.view(np.int64) for x in numbers_), skip.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), prefix], ["doc_id", "h", "line", "n", "ck", "sa", "sb", "skip", "prefix"])

    return run


def groups_of(level: np.ndarray) -> np.ndarray:
    """How many groups the list of a word of each level is dealt in; 1 for most."""
    most = 2.0 ** ((np.arange(256) - 1) / 4)  # the largest count of the level
    return np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(most / BLOCK, 1)))).astype(np.int64)


_POSTING = [("list", np.uint32), ("ck", np.int64), ("sa", np.int64), ("sb", np.int64), ("doc_id", np.int64), ("line", np.int32), ("n", np.int32), ("pos", np.int32)]


def _deal(level: np.ndarray, buckets: int, only: np.ndarray | None):
    """Postings as (bucket, number of postings, block). only: the words (their hashes' upper half, sorted) that are posted, or None for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        groups = groups_of(level)
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def emit() -> pa.RecordBatch:
            col = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            order = np.argsort(col["bucket"], kind="stable")
            found, first = np.unique(col["bucket"][order], return_index=True)
            col = {c: col[c][order] for c, _ in _POSTING}
            ends = [*first[1:].tolist(), len(order)]
            blocks = [press(b"".join(np.ascontiguousarray(col[c][a:z], t).tobytes() for c, t in _POSTING)) for a, z in zip(first.tolist(), ends, strict=True)]
            sizes = np.array(ends, np.int64) - first
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "size", "block"])

        for batch in batches:
            prefix = batch.column("prefix")
            size = np.diff(prefix.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            word = prefix.flatten().to_numpy().view(np.uint32)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + batch.column("skip").to_numpy()[row]
            if only is not None:
                at = np.flatnonzero(only[np.minimum(np.searchsorted(only, word), len(only) - 1)] == word) if len(only) else np.zeros(0, np.int64)
                row, word, pos = row[at], word[at], pos[at]
            ck = batch.column("ck").to_numpy()
            parts = groups[level[word >> np.uint32(32 - BUCKET_BITS)]]
            cell = np.zeros(len(word), np.uint64)
            if (parts > 1).any():
                own = (_mix(ck.view(np.uint64)[row]) % parts.astype(np.uint64)).astype(np.int64)
                times = np.repeat(np.arange(len(word)), parts)
                other = np.arange(len(times)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = own[times]
                cell = (np.minimum(own, other) << 20 | np.maximum(own, other)).astype(np.uint64)
                row, word, pos = row[times], word[times], pos[times]
            key = _mix(word.astype(np.uint64) + (cell + np.uint64(1)) * _P)
            col = {c: batch.column(c).to_numpy()[row] for c in ("ck", "sa", "sb", "doc_id", "line", "n")}
            held.append(col | {"pos": pos, "list": key.astype(np.uint32), "bucket": (key >> np.uint64(32)) % np.uint64(buckets)})
            count += len(row)
            if count > FLUSH:
                yield emit()
                held, count = [], 0
        if count:
            yield emit()

    return run


def candidate_pairs(lists: np.ndarray, n: np.ndarray, pos: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list that pass the length, positional and sketch filters. Rows are in order of list and n.

    With t words in both, at least 4t/9 are shared. Of a row with r words from its place on, that leaves partners of at most 9r/4 - n
    words: a window of the rows that follow.
    """
    new = np.ones(len(lists), bool)
    new[1:] = lists[1:] != lists[:-1]
    key = np.cumsum(new) << 32 | n
    rest = n - pos
    last = np.minimum(5 * n // 4, 9 * rest // 4 - n)
    size = np.searchsorted(key, (key & ~np.int64(0xFFFFFFFF)) | np.maximum(last, 0), "right") - np.arange(len(n)) - 1
    size = np.maximum(size, 0)
    ends = np.cumsum(size)
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        some = size[a:z]
        i = np.repeat(np.arange(a, z), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        total = n[i] + n[j]
        least = (4 * total + 8) // 9
        good = np.flatnonzero(rest[j] >= least)
        i, j, most = i[good], j[good], (total - 2 * least)[good]
        apart = np.bitwise_count(sa[i] ^ sa[j]) + np.bitwise_count(sb[i] ^ sb[j])
        good = apart <= most
        yield i[good], j[good]
        a = z


def _match(probe: np.ndarray | None):
    """Buckets come whole. The earliest candidate of each class; of the classes in probe (sorted ck; empty: of all) all candidates."""
    names = ["ck", "sa", "doc_id", "line", "ck2", "sa2", "doc_id2", "line2", "more"]

    def work(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        unpress = zstandard.ZstdDecompressor().decompress
        parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in _POSTING}
        for size, block in blocks:
            data, at = unpress(block), 0
            for c, t in _POSTING:
                parts[c].append(np.frombuffer(data, t, size, at))
                at += size * np.dtype(t).itemsize
        col = {c: np.concatenate(x) for c, x in parts.items()}
        order = np.lexsort((col["line"], col["doc_id"], col["sa"], col["ck"], col["list"]))
        once = np.ones(len(order), bool)  # a class once in each list, at its earliest place
        once[1:] = np.any([col[c][order][1:] != col[c][order][:-1] for c in ("list", "ck", "sa")], axis=0)
        order = order[once]
        order = order[np.lexsort((col["n"][order], col["list"][order]))]
        col = {c: x[order] for c, x in col.items()}
        n, pos = col["n"].astype(np.int64), col["pos"].astype(np.int64)
        age = np.empty(len(n), np.int64)
        ranked = np.lexsort((col["sa"], col["ck"], col["line"], col["doc_id"]))
        fresh = np.ones(len(n), bool)
        fresh[1:] = np.any([col[c][ranked][1:] != col[c][ranked][:-1] for c in ("doc_id", "line", "ck", "sa")], axis=0)
        age[ranked] = np.cumsum(fresh)
        row_of = np.zeros(len(n) + 1, np.int64)
        row_of[age] = np.arange(len(n))
        found = []
        for i, j in candidate_pairs(col["list"], n, pos, col["sa"].view(np.uint64), col["sb"].view(np.uint64)):
            a, b = age[i], age[j]
            found.append(np.unique(np.maximum(a, b) << 32 | np.minimum(a, b)))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        later, earlier = row_of[pairs >> 32], row_of[pairs & 0xFFFFFFFF]
        if probe is None:
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] >> 32 != pairs[:-1] >> 32
            more = np.append(~first[1:], False)[first] if len(pairs) else first
            later, earlier = later[first], earlier[first]
        else:
            if len(probe):
                ck = col["ck"][later]
                asked = probe[np.minimum(np.searchsorted(probe, ck), len(probe) - 1)] == ck
                later, earlier = later[asked], earlier[asked]
            more = np.zeros(len(later), bool)
        if not len(later):
            return None
        out = [col[c][x] for x in (later, earlier) for c in ("ck", "sa", "doc_id", "line")]
        return pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(more)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for bucket, size, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    if blocks and (out := work(blocks)):
                        yield out
                    now, blocks = bucket, []
                blocks.append((size, block))
        if blocks and (out := work(blocks)):
            yield out

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted lines. Columns: doc_id, text, wanted (line numbers)."""
    level = np.zeros(1 << BUCKET_BITS, np.uint8)
    for batch in batches:
        found: dict[int, bytes] = {}
        keys = []
        for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.translate(_TABLE).split(b"\n")
            kept = [b" ".join(sorted(set(lines[k].split()))) for k in sorted(set(wanted)) if k < len(lines)]
            kept = [k for k in kept if k]
            if kept:
                sets = Lines(level, b"\n".join(kept))
                for ck, sa, words in zip(sets.ck.view(np.int64).tolist(), sets.sa.view(np.int64).tolist(), kept, strict=True):
                    if ck not in found:
                        found[ck] = words
                        keys.append((ck, sa, words))
        cols = zip(*keys, strict=True) if keys else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["ck", "sa", "words"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = set(a.split()), set(b.split())
            both = len(x & y)
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep)], ["ck", "sa", "similar"])


def _rarity(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A byte for each bucket: 0 unmet, 1 once, then steps of a quarter of a doubling; and the number of words."""
    counted = rows.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    level, n = np.zeros(1 << BUCKET_BITS, np.uint8), counted["n"].to_numpy()
    if len(n):
        level[counted["bucket"].to_numpy()] = np.where(n <= 1, n, np.minimum(2 + 4 * np.log2(n), 255)).astype(np.uint8)
    return level, int(n.sum())


def _bounded(side: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _few(rows: DataFrame, column: str, kind: type) -> np.ndarray | None:
    """The different values of a column, sorted, or None where there are more than BROADCAST_ROWS."""
    found = rows.select(column).distinct().limit(BROADCAST_ROWS + 1).toArrow()[column].to_numpy()
    return np.unique(found.view(kind)) if len(found) <= BROADCAST_ROWS else None


def _similar(rows: DataFrame, lines: DataFrame, level: np.ndarray, words: int) -> DataFrame:
    """(ck, sa) of the classes that have a similar class that comes earlier."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(level)
    buckets = max(1, words // 4 // POSTINGS)
    posted = lines.where(F.size("prefix") > 0).drop("h")
    kinds = "ck long, sa long, doc_id long, line int, ck2 long, sa2 long, doc_id2 long, line2 int, more boolean"

    def round_(only: np.ndarray | None, probe: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
        blocks = posted.mapInArrow(lambda it: _deal(shared.value, buckets, only)(it), "bucket int, size int, block binary")
        pairs = stash(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_match(probe), kinds), "line-candidates")
        ends = pairs.select("doc_id", "line").union(pairs.select("doc_id2", "line2"))
        wanted = _bounded(stash(ends.groupBy("doc_id").agg(F.collect_set("line").alias("wanted")), "lines-wanted"))
        sets = rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_sets, "ck long, sa long, words binary").dropDuplicates(_CLASS)
        sets = stash(sets, "line-sets")
        unique = pairs.select("ck", "sa", "ck2", "sa2").distinct()
        other = sets.select(F.col("ck").alias("ck2"), F.col("sa").alias("sa2"), F.col("words").alias("words2"))
        checked = unique.join(sets, _CLASS).join(other, ["ck2", "sa2"]).select("ck", "sa", "words", "words2").mapInArrow(_verify, "ck long, sa long, similar boolean")
        return pairs, stash(checked.where("similar").select(*_CLASS).distinct(), "lines-similar")

    pairs, done = round_(None, None)
    left = stash(pairs.where("more").select(*_CLASS).distinct().join(done, _CLASS, "left_anti"), "lines-open")
    if left.isEmpty():
        return done
    probe = _few(left, "ck", np.int64)
    if probe is None:  # too many to tell each task: all candidates of all classes
        return round_(None, np.zeros(0, np.int64))[1]
    prefixes = posted.join(_bounded(left), _CLASS, "left_semi").select(F.explode("prefix").alias("word"))
    return done.union(round_(_few(prefixes, "word", np.uint32), probe)[1]).distinct()


def _row_key() -> tuple[Column, Column]:
    """A row's id (the largest long where there is none) and the hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")


def _removed(docs: DataFrame) -> DataFrame:
    """doc_id, h, removed: the lines that go, for rows with any."""
    session(docs)
    rows = docs.select(*_row_key(), text_bytes().alias("text"))
    level, words = _rarity(rows)
    shared = docs.sparkSession.sparkContext.broadcast(level)
    lines = stash(rows.mapInArrow(lambda it: _prefixes(shared.value)(it), _LINE), "lines")
    classes = lines.groupBy(*_CLASS).agg(F.min(F.struct("doc_id", "line", "h")).alias("first"), F.count("*").alias("copies"))
    near = _similar(rows, lines, level, words).withColumn("near", F.lit(True))
    known = classes.join(near, _CLASS, "left").where("copies > 1 or near").drop("copies")
    verdicts = lines.select("doc_id", "line", "h", *_CLASS).join(known, _CLASS)
    gone = verdicts.where(F.col("near").isNotNull() | (F.struct("doc_id", "line", "h") != F.col("first")))
    return gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending).

    Reads doc_id and text; other columns are ignored. Lines are parted by line feeds. A line without words is never removed. A
    null text counts as empty: one line without words. Rows without id come last in the order. A row is its id and text: rows that
    repeat both are the same lines and get the same verdicts; rows that share an id alone are judged each for itself, those
    at equal line numbers in an order by hash. A long text is cut between lines. An empty table gives no rows.
    """
    removed = _removed(docs).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    doc_id, h = _row_key()
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), doc_id.alias("__id"), h.alias("__h"),
        F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).cast("long").alias("n_lines"),
    )
    found = out.join(removed, ["__id", "__h"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def deduplicated_rows(docs: DataFrame) -> DataFrame:
    """docs without the removed lines, all other columns as they are."""
    removed = _removed(docs).withColumnsRenamed({"doc_id": "__id", "h": "__h", "removed": "__removed"})
    doc_id, h = _row_key()
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    keyed = docs.withColumns({"__id": doc_id, "__h": h}).join(removed, ["__id", "__h"], "left")
    return keyed.withColumn("text", F.when(F.size("__removed") > 0, kept).otherwise(F.col("text"))).select(*docs.columns)
