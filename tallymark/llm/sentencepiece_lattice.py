"""SentencePiece encoding and decoding over a relational lattice.

Words (a run of word marks and what follows up to the next mark; no piece crosses one) are taken from the corpus once each.
Their substrings up to the longest piece are exploded, equi-joined to the piece table, and grouped by word; the higher-order
`aggregate` folds a word's edges to its segmentation. For a unigram model that is Viterbi's: the best path to each position. For a
byte-pair model that path is not SentencePiece's own (in a sample of 41,888 words of these corpora it differed in 58 %), so the fold
goes through the edges from the best score to the worst, and lays each that joins two neighbours which stand at that moment. That is
what the library's merging does, as long as no piece is made of a part with a worse score than its own: two neighbours make up a
piece only out of its own characters, so if each piece comes out of its own characters in that order, every word does. The few pieces
that don't are found when a model is loaded, and words that hold one are merged in place, as are words beyond MAX_WORD characters,
whose lattice would be long.

What is met of a byte-pair model's pieces, side by side in one of them, makes classes of characters (here: letters of a script,
punctuation). No piece holds characters of two classes, so nothing is merged across, and a word is cut into its runs of one class
first. Runs come back in far more words than words do, and are shorter. The lattice is made of runs; for a unigram model of whole words.

Frequent runs, at most CACHE_WORDS, are encoded first and go to all tasks. The rest is sent once, from the documents to their
runs and back to chunks of documents, where each text is put together. A chunk is a stretch of an input partition. Where a partition
is read in another order the second time, runs may be missing in a chunk: those are merged in place, to the same ids.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm._shared import session, stash

MARK = "▁"
MAX_WORD, CACHE_WORDS, CACHE_BYTES, CHUNK_BYTES = 48, 300_000, 8 << 20, 8 << 20
#: A map task reports a word to the frequency count from so many occurrences in a slice of its documents.
LEAST_SEEN, SLICE_WORDS = 4, 1 << 22
#: Words that are cut into runs at a time.
RUN_WORDS = 1 << 16
#: Arrow batches of words; entries that a task gathers before it sends them to chunks; words whose edges a task holds in a hash table.
WORD_ROWS, WORD_BYTES, CHUNK_ENTRIES, HELD_WORDS = 16384, 4 << 20, 1 << 18, 1 << 16
#: Text whose rare words make one task, on average; tasks at most; parts that a task's words are dealt in.
TASK_BYTES, MAX_TASKS, PARTS = 4 << 20, 1 << 16, 8
#: Where an edge keeps its score's rank, start and length, and its id; and what marks the bytes of a character that is no piece.
_RANK, _START, _LENGTH, _OTHER = 40, 32, 24, 1 << 36
UNIGRAM, BPE = 1, 2
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            n = varint() if n is None else n
            yield key >> 3, message[at : at + n]
            at += n


class Pieces:
    """A model's pieces. Made by `load` from a file on the driver, or of (piece, score) pairs for a model without bytes."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], plain: Sequence[bool], kind: int, bytes_at: int | None, unknown: int) -> None:
        self.pieces, self.scores, self.plain, self.kind, self.bytes_at, self.unknown = list(pieces), list(scores), list(plain), kind, bytes_at, unknown
        self.longest = max((len(p) for p, ok in zip(pieces, plain, strict=True) if ok), default=1)
        self.odd = self._odd() if kind == BPE else ()
        self._runs = self._classes() if kind == BPE else re.compile(f"{MARK}*[^{MARK} ]+|{MARK}+")

    def table(self) -> dict[str, tuple[float, int]]:
        """Score and id of each piece."""
        return {p: (s, i) for i, (p, s, ok) in enumerate(zip(self.pieces, self.scores, self.plain, strict=True)) if ok}

    def _odd(self) -> tuple[str, ...]:
        """Pieces that one pass over the edges, best score first, doesn't make of their characters."""
        table, odd = self.table(), []
        for piece in table:
            n, ends = len(piece), [*range(1, len(piece) + 1), 0]
            spans = ((a, z) for a in range(n) for z in range(a + 2, min(n, a + self.longest) + 1))
            for _, a, z in sorted((-table[piece[a:z]][0], a, z) for a, z in spans if piece[a:z] in table):
                if ends[a] and ends[ends[a]] == z:
                    ends[ends[a]], ends[a] = 0, z
            if ends[0] < n:
                odd.append(piece)
        return tuple(odd)

    def _classes(self) -> re.Pattern[str]:
        """A pattern of runs that no piece crosses. Word marks stand before a run only; a character that joins no other is a run."""
        above: dict[str, str] = {}

        def top(c: str) -> str:
            while (up := above.setdefault(c, c)) != c:
                above[c] = above[up]
                c = up
            return c

        for piece, ok in zip(self.pieces, self.plain, strict=True):
            bare = piece.lstrip(MARK) if ok else ""
            for a, b in zip(bare, bare[1:]):
                above[top(a)] = top(b)
        classes: dict[str, list[str]] = {}
        for c in sorted(above):
            classes.setdefault(top(c), []).append(re.escape(c))
        ways = [f"[{''.join(cs)}]+" for cs in sorted(classes.values(), key=len, reverse=True)]
        return re.compile(f"{MARK}*(?:{'|'.join([*ways, f'[^{MARK} ]'])})|{MARK}+")

    def runs(self, words: Iterable[str]) -> list[str]:
        """The runs of words in order, the first of each with its mark. No word has a blank."""
        return self._runs.findall(" ".join([w if w[0] == MARK else MARK + w for w in words]))

    def cut(self, word: str) -> list[str]:
        """The runs of a word that has its mark, or of several with blanks between."""
        return self._runs.findall(word)

    def in_lattice(self, runs: pa.Array) -> pa.Array:
        """Which runs don't stay out of the lattice."""
        within = pc.less_equal(pc.utf8_length(runs), MAX_WORD)
        for odd in self.odd:
            within = pc.and_not(within, pc.match_substring(runs, odd))
        return within

    def in_place(self, word: str) -> bool:
        """Whether a word stays out of the lattice."""
        return len(word) > MAX_WORD or any(o in marked(word) for o in self.odd)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            trainer = dict(_fields(dict(_fields(f.read()))[2]))
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        first_byte = next((i for i in range(n) if sp.is_byte(i)), None)
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [not x for x in special], trainer.get(3, UNIGRAM), first_byte, sp.unk_id())

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, id, score, and the score's rank, 0 the best: bounded by the vocabulary."""
        ranks = {s: i for i, s in enumerate(sorted(set(self.scores), reverse=True))}
        columns = {"id": pa.array(range(len(self.pieces)), pa.int32()), "score": pa.array(self.scores, pa.float64()), "rank": pa.array([ranks[s] for s in self.scores], pa.int64())}
        return spark.createDataFrame(pa.table({"piece": self.pieces} | columns).filter(pa.array(self.plain)))

    def raw(self) -> list[bytes]:
        """What each id decodes to, marks as blanks."""
        out = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(self.pieces, self.plain, strict=True)]
        if self.bytes_at is not None:
            out[self.bytes_at : self.bytes_at + 256] = [bytes([b]) for b in range(256)]
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.unknown] if self.bytes_at is None else [self.bytes_at + b for b in char.encode()]


def words_of(text: str) -> list[str]:
    """The words of a text in order, without their word mark where it is a single one."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w if w[1:2] in ("", MARK) else w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))]


def marked(word: str) -> str:
    """The word with its mark."""
    return word if word[0] == MARK else MARK + word


def decode(ids: Sequence[int], raw: Sequence[bytes]) -> str:
    """The text of ids. raw: `Pieces.raw()`."""
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def merge_long(word: str, pieces: Pieces, table: dict[str, tuple[float, int]]) -> list[int]:
    """Best pair first, the leftmost of equals, with a heap. table: piece to (score, id)."""
    if pieces.kind == UNIGRAM:
        return _viterbi_long(word, pieces, table)
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), [*range(-1, n - 1)], [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and ends[a] < n and (found := table.get(word[a : ends[ends[a]]])):
            heapq.heappush(heap, (-found[0], a, ends[ends[a]]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, end = heapq.heappop(heap)
        if not alive[a] or ends[a] >= n or ends[ends[a]] != end:
            continue
        alive[ends[a]] = False
        ends[a] = end
        if end < n:
            before[end] = a
        offer(before[a])
        offer(a)
    out, a = [], 0
    while a < n:
        found = table.get(word[a : ends[a]])
        out += [found[1]] if found else pieces.fallback(word[a])
        a = ends[a]
    return out


def _viterbi_long(word: str, pieces: Pieces, table: dict[str, tuple[float, int]]) -> list[int]:
    best: list[tuple[float, int]] = [(0.0, 0)]
    low = min(pieces.scores) - 10
    for e in range(1, len(word) + 1):
        options = []
        for a in range(max(0, e - pieces.longest), e):
            found = table.get(word[a:e])
            if found or e - a == 1:
                options.append((best[a][0] + (found[0] if found else low), -a))
        top = max(options)
        best.append((top[0], -top[1]))
    out, e = [], len(word)
    while e:
        a = best[e][1]
        found = table.get(word[a:e])
        out[:0] = [found[1]] if found else pieces.fallback(word[a])
        e = a
    return out


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words with s, l, piece, id, score, rank: the pieces at each place of `marked`, and its other characters without id.

    All rows of a word stay together and in order: nothing is shuffled, as the piece table is bounded by the vocabulary.
    """
    table = F.broadcast(pieces.frame(words.sparkSession))
    n = F.char_length("marked")
    starts = words.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s")))).alias("l"))
    subs = spans.withColumn("piece", F.col("marked").substr(F.col("s") + 1, F.col("l")))
    return subs.join(table, "piece", "left").where("id is not null or l = 1")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _best_path(edges: Column, word: Column, low: float) -> tuple[Column, Column]:
    """At each position the best (score, start); and the boundaries of the best path, back from the end, with the former as `best`."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("a")))

    def step(best: Column, e: Column) -> Column:
        here = F.filter(edges, lambda x: x["s"] + x["l"] == e)
        options = F.transform(here, lambda x: F.struct((F.get(best, x["s"])["score"] + F.coalesce(x["score"], F.lit(low))).alias("score"), (-x["s"]).alias("a")))
        top = _let(F.array_max(options), lambda t: F.struct(t["score"].alias("score"), (-t["a"]).alias("a")))
        return F.concat(best, F.array(top))

    best = F.aggregate(F.sequence(F.lit(1), F.char_length(word)), first, step)

    def back(path: Column, _: Column) -> Column:
        at = F.get(path, F.lit(0))
        return F.when(at == 0, path).otherwise(F.concat(F.array(F.get(F.col("best"), at)["a"]), path))

    return best, F.aggregate(F.sequence(F.lit(1), F.char_length(word)), F.array(F.char_length(word)), back)


def _viterbi(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words with ids by the best path."""
    carry, by = _carried(words)
    grouped = lattice(words, pieces).groupBy(*by, "marked").agg(*(F.first(c).alias(c) for c in carry if c not in by), F.collect_list(F.struct("s", "l", "score", "id")).alias("edges"))
    best, path = _best_path(F.col("edges"), F.col("marked"), min(pieces.scores) - 10)
    cut = grouped.withColumn("best", best).withColumn("b", path)

    def ids_of(i: Column) -> Column:
        found = F.filter("edges", lambda e: (e["s"] == F.get("b", i)) & (e["s"] + e["l"] == F.get("b", i + 1)) & e["id"].isNotNull())
        if pieces.bytes_at is None:
            other = F.array(F.lit(pieces.unknown))
        else:
            code = F.hex(F.encode(F.col("marked").substr(F.get("b", i) + 1, F.lit(1)), "UTF-8"))
            other = F.transform(F.filter(F.split(code, "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int") + pieces.bytes_at)
        return _let(F.get(found, F.lit(0))["id"], lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(other))

    ids = F.flatten(F.transform(F.sequence(F.lit(0), F.size("b") - 2), ids_of))
    return cut.select(*carry, ids.alias("ids"))


def _carried(words: DataFrame) -> tuple[list[str], list[str]]:
    """The columns beside `marked`; and those to group by, of which the first may be what the words are dealt by."""
    carry = [c for c in words.columns if c != "marked"]
    return carry, [c for c in ("part", "word") if c in carry]


def _merged(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words with ids by merging, best score first, the leftmost of equals.

    An edge is one number: rank, start, length, id. The fold's state is one number too: a bit for each place where a symbol starts, and for
    the end. An edge joins two neighbours where its first and last bit are set, and one between them, which is cleared. In the end a symbol is
    an edge, or a character, with its first and last bit set and none between. Characters that are no piece have their bytes in place of the id.
    """
    carry, by = _carried(words)
    whole = F.col("l") > 1
    edge = F.col("rank") * (1 << _RANK) + F.col("s") * (1 << _START) + F.col("l") * (1 << _LENGTH) + F.col("id")
    code = F.conv(F.hex(F.encode("piece", "UTF-8")), 16, 10).cast("long")
    char = F.col("s") * (1 << _RANK) + F.coalesce(F.col("id") + F.lit(1).cast("long"), code + _OTHER)
    lists = {"edges": F.when(whole, edge), "chars": F.when(~whole, char)}
    first = [F.first(c).alias(c) for c in [*carry, "marked"] if c not in by]
    grouped = lattice(words, pieces).groupBy(*by).agg(*first, *(F.collect_list(c).alias(k) for k, c in lists.items()))
    field = lambda x, at, bits: F.shiftright(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    left = lambda x, n: F.call_function("shiftleft", F.lit(x).cast("long") if isinstance(x, int) else x, n)
    right = lambda x, n: F.call_function("shiftright", x, n)
    start, length = (lambda e: field(e, _START, 8).cast("int")), (lambda e: field(e, _LENGTH, 8).cast("int"))
    bits = lambda state, e: right(state, start(e)).bitwiseAND(left(2, length(e)) - 1)
    ends = lambda e: left(1, length(e)) + 1

    def lay(state: Column, e: Column) -> Column:
        joins = (F.bit_count(bits(state, e)) == 3) & (bits(state, e).bitwiseAND(ends(e)) == ends(e))
        return F.when(joins, state.bitwiseAND(F.bitwise_not(left(left(1, length(e)) - 2, start(e))))).otherwise(state)

    cut = grouped.withColumn("state", F.aggregate(F.sort_array("edges"), left(2, F.char_length("marked")) - 1, lay))
    laid = F.transform(F.filter("edges", lambda e: bits(F.col("state"), e) == ends(e)), lambda e: field(e, _START, 8) * (1 << _RANK) + field(e, 0, _LENGTH) + 1)
    single = F.filter("chars", lambda c: right(F.col("state"), F.shiftright(c, _RANK).cast("int")).bitwiseAND(F.lit(3)) == 3)
    symbols = F.transform(F.sort_array(F.concat(laid, single)), lambda x: field(x, 0, _RANK))

    def id_or_bytes(x: Column) -> Column:
        if pieces.bytes_at is None:
            other = F.array(F.lit(pieces.unknown))
        else:
            n = F.ceil(F.length(F.hex(field(x, 0, 32))) / 2).cast("int")
            other = F.transform(F.sequence(F.lit(1), n), lambda k: (right(x, 8 * (n - k)).bitwiseAND(F.lit(255)) + pieces.bytes_at).cast("int"))
        return F.when(x >= _OTHER, other).otherwise(F.array((x - 1).cast("int")))

    plain = F.transform("symbols", lambda x: (x - 1).cast("int"))
    ids = F.when(F.exists("symbols", lambda x: x >= _OTHER), F.flatten(F.transform("symbols", id_or_bytes))).otherwise(plain)
    return cut.withColumn("symbols", symbols).select(*carry, ids.alias("ids"))


def _encode_runs(runs: DataFrame, pieces: Pieces) -> DataFrame:
    """Runs, as `word`, with ids."""
    known = runs.withColumn("marked", F.col("word"))
    return _viterbi(known, pieces) if pieces.kind == UNIGRAM else _merged(known, pieces)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words with ids. words: word (distinct, not empty, none that stays out of the lattice), further columns; `part`, if they are dealt by it."""
    known = words.withColumn("marked", F.when(F.col("word").startswith(MARK), F.col("word")).otherwise(F.concat(F.lit(MARK), "word")))
    return _viterbi(known, pieces) if pieces.kind == UNIGRAM else _merged(known, pieces)


def _words(texts: pa.Array) -> pa.ListArray:
    """`words_of` of each text."""
    texts = texts.cast(pa.string())
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.match_substring_regex(texts, r"\A(?: |\z)| \z"))
    split = pc.split_pattern(texts, " ")
    if not pc.any(odd).as_py():
        return split
    others = pa.array([words_of(t) for t in texts.filter(odd).to_pylist()], split.type)
    where = np.arange(len(texts))
    where[odd.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(others))
    return pa.concat_arrays([split, others]).take(pa.array(where))


def _joined(words: pa.Array) -> bytes:
    """The words, none of which has a blank, with blanks between."""
    return pc.binary_join(_lists(np.array([len(words)]), words), " ")[0].as_buffer().to_pybytes()


def _runs(words: pa.Array, pieces: Pieces) -> pa.Array:
    """The runs of words in order, the first of each with its mark, and no other."""
    whole = pc.if_else(pc.starts_with(words, MARK), words, pc.binary_join_element_wise(MARK, words, ""))
    parts = (_joined(whole.slice(a, RUN_WORDS)).decode() for a in range(0, len(words), RUN_WORDS))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(pieces.cut(part), pa.string()) for part in parts)])


def _firsts(runs: pa.Array) -> np.ndarray:
    """Where the words of `_runs` begin."""
    return np.flatnonzero(pc.starts_with(runs, MARK).to_numpy(zero_copy_only=False))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths)), values)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, in the order they had; the different keys; how many there are of each."""
    different, counts = np.unique(keys, return_counts=True)
    return np.argsort(keys, kind="stable"), different, counts


def _frequent(pieces: Pieces, least: int, slice_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report() -> pa.RecordBatch:
            counted = pa.concat_arrays([pa.array([], pa.string()), *held]).value_counts()
            counted = counted.filter(pc.greater(counted.field(1), 1))  # the others are mostly not worth their cutting
            runs = _runs(counted.field(0), pieces)
            each = counted.field(1).to_numpy().repeat(np.diff(_firsts(runs), append=len(runs)))
            coded = runs.dictionary_encode()
            met = np.bincount(coded.indices.to_numpy(), each, len(coded.dictionary)).astype(np.int64)
            held.clear()
            kept = pc.and_(pa.array(met >= least), pieces.in_lattice(coded.dictionary))
            return pa.RecordBatch.from_arrays([coded.dictionary.filter(kept), pa.array(met).filter(kept)], ["word", "n"])

        held: list[pa.Array] = []
        for batch in batches:
            held.append(_words(batch.column(0)).flatten())
            if sum(map(len, held)) > slice_words:
                yield report()
        yield report()

    return run


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The documents of each chunk, batch by batch."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        a, lengths = 0, pc.utf8_length(batch.column(1)).to_pylist()
        for z, length in enumerate(lengths, 1):
            held += length
            if held > chunk_bytes or z == len(lengths):
                yield chunk, batch.slice(a, z - a)
                a = z
            if held > chunk_bytes:
                chunk, held = chunk + 1, 0


def _rare(cache: pa.Table, pieces: Pieces, chunk_bytes: int, parts: int):
    """(part, chunk, words) for runs that are not in the cache, once for each chunk: in order, with blanks between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(chunk: int) -> pa.RecordBatch:
            runs = _runs(pa.concat_arrays(held).unique(), pieces).unique()
            runs = runs.filter(pc.and_(pieces.in_lattice(runs), pc.invert(pc.is_in(runs, cached))))
            runs = runs.take(pc.sort_indices(runs))
            order, dealt, counts = _grouped(np.fromiter(map(zlib.crc32, _joined(runs).split(b" ")[: len(runs)]), np.int64, len(runs)) % parts)
            words = pc.binary_join(_lists(counts, runs.take(pa.array(order))), " ")
            return pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), pa.array([chunk] * len(dealt), pa.int64()), words], ["part", "chunk", "words"])

        cached = cache["word"].combine_chunks()
        now, held = None, []
        for chunk, batch in _chunks(batches, chunk_bytes):
            if chunk != now and held:
                yield emit(now)
                held.clear()
            now = chunk
            held.append(_words(batch.column(1)).flatten().unique())
        if held:
            yield emit(now)

    return run


def _blobs(chunk_bytes: int):
    """Each chunk's documents, compressed: what is shuffled is a third of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_press(batch)], pa.binary())], ["chunk", "blob"])

    return run


def _press(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _unpress(blob: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob))


def _by_chunk(entries: int):
    """Encoded runs for the chunks that asked for them, compressed by chunk: the runs in order, and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6).compress

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("word").combine_chunks()
            held.clear()
            words, chunks, ids = (rows[c].combine_chunks() for c in ("word", "chunks", "ids"))
            order, asking, counts = _grouped(chunks.flatten().to_numpy())
            of = chunks.value_parent_indices().take(pa.array(order))
            joined = pc.binary_join(_lists(counts, words.cast(pa.string()).take(of)), " ").cast(pa.binary()).to_pylist()  # no word has a blank
            ids = ids.take(of)
            lengths, values = np.diff(ids.offsets.to_numpy()).astype("<u2"), ids.flatten().to_numpy().astype("<u4")
            at, ends = ids.offsets.to_numpy() - ids.offsets[0].as_py(), _offsets(counts)
            blobs = []
            for a, z, text in zip(ends[:-1].tolist(), ends[1:].tolist(), joined, strict=True):
                blobs.append(press(struct.pack("<II", z - a, len(text)) + text + lengths[a:z].tobytes() + _halves(values[at[a] : at[z]])))
            return pa.RecordBatch.from_arrays([pa.array(asking, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "words"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(batch.schema.get_field_index("chunks")).flatten())
            if n > entries:
                yield emit()
                n = 0
        if n:
            yield emit()

    return run


def _halves(ids: np.ndarray) -> bytes:
    """All ids, their lower halves before their upper halves, which are mostly 0."""
    return ids.view("<u2").reshape(-1, 2).T.tobytes()


def _read_words(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs, how many ids each has, and these ids."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, size = struct.unpack_from("<II", data)
    lengths = np.frombuffer(data, "<u2", n, 8 + size)
    ids = np.ascontiguousarray(np.frombuffer(data, "<u2", -1, 8 + size + 2 * n).reshape(2, -1).T).view("<i4").reshape(-1)
    return pc.split_pattern(pa.array([data[8 : 8 + size]], pa.string()), " ").flatten(), lengths, ids


def _assemble(pieces: Pieces, cache: pa.Table, with_ids: bool):
    names = ["doc_id", "n_words", "n_pieces", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.list_(pa.int32())] * with_ids
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    table, raw = pieces.table(), pieces.raw()
    raw_bytes = pa.array(raw, pa.binary())

    def ids_of(words: pa.Array, known: pa.Array, known_ids: pa.ListArray) -> pa.ListArray:
        """The ids of words, put together of their runs; what isn't known is merged in place."""
        runs = _runs(words, pieces)
        at = pc.index_in(runs, known)
        if at.null_count:
            others = runs.filter(at.is_null()).unique()
            known_ids = pa.concat_arrays([known_ids, pa.array([merge_long(r, pieces, table) for r in others.to_pylist()], known_ids.type)])
            at = pc.coalesce(at, pc.add(pc.index_in(runs, others), len(known)))
        ids = known_ids.take(at)
        lengths = np.diff(ids.offsets.to_numpy())
        return _lists(np.add.reduceat(lengths, _firsts(runs)) if len(words) else lengths, ids.flatten())

    def encoded(batch: pa.RecordBatch, counts: np.ndarray, word_ids: pa.ListArray) -> pa.RecordBatch:
        ends = word_ids.offsets.to_numpy()[_offsets(counts)]
        ids = word_ids.flatten()
        data, found = memoryview(ids.to_numpy()).cast("B"), raw_bytes.take(ids)
        at = np.frombuffer(found.buffers()[1], np.int32, len(ids) + 1)[ends].tolist() if len(ids) else [0] * len(ends)
        out, same, crcs = found.buffers()[2].to_pybytes() if len(ids) else b"", [], []
        for k, (a, z, text) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column(1).to_pylist(), strict=True)):
            crcs.append(zlib.crc32(data[4 * a : 4 * z]))
            text = text.replace(MARK, " ")
            same.append(out[at[k] : at[k + 1]] == b" " + text.encode() or decode(ids[a:z].to_pylist(), raw) == text)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(pa.array(ends), ids)] * with_ids, schema=schema)

    def run(blobs: pa.Table, words: pa.Table) -> pa.Table:
        sent = [_read_words(blob.as_buffer()) for blob in words["words"]]
        known = pa.concat_arrays([*cache["word"].chunks, *(w for w, _, _ in sent), pa.array([], pa.string())])
        lists = [_lists(lengths, pa.array(ids, pa.int32())) for _, lengths, ids in sent]
        known_ids = pa.concat_arrays([*cache["ids"].chunks, *lists, pa.array([], pa.list_(pa.int32()))])
        batches = [batch for blob in blobs["blob"] for batch in _unpress(blob.as_buffer())]
        split = [_words(batch.column(1)) for batch in batches]
        coded = pa.concat_arrays([*(s.flatten() for s in split), pa.array([], pa.string())]).dictionary_encode()
        counts = [pc.list_value_length(s).to_numpy() for s in split]
        del split, sent, lists
        each, a, out = ids_of(coded.dictionary, known, known_ids), 0, []
        for batch, n in zip(batches, counts, strict=True):  # neither side of the pipe holds a whole chunk's ids in one piece
            out.append(encoded(batch, n, each.take(coded.indices.slice(a, int(n.sum())))))
            a += int(n.sum())
        return pa.Table.from_batches(out, schema)

    return run


def encode(docs: DataFrame, pieces: Pieces, cache_words: int = CACHE_WORDS, chunk_bytes: int = CHUNK_BYTES, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit), round_trip, ids.

    Reads doc_id and text; other columns are ignored. A null text counts as empty, which has no pieces. round_trip: the document's
    ids are decoded and are the text, with word marks in it as blanks. Rows that repeat an id are encoded each for itself. A chunk
    ends with the document that fills it, so a very long text is a chunk of its own at most. Without with_ids the ids stay behind.
    An empty table gives no rows.
    """
    spark = session(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WORD_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(WORD_BYTES))
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(HELD_WORDS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.select("text").mapInArrow(_frequent(pieces, LEAST_SEEN, SLICE_WORDS), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = counted.orderBy(F.desc("n"), "word").limit(cache_words).select("word")
    ids = stash(_encode_runs(stash(common, "common-words").repartition(-(-cache_words // HELD_WORDS) + 1, "word"), pieces), "common-ids")
    bounded = ids.select("word", "ids").toArrow()  # at most cache_words short rows
    bounded = bounded.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
    sizes = np.array(pc.binary_length(bounded["word"])) + 4 * np.array(pc.list_value_length(bounded["ids"]))
    shared = spark.sparkContext.broadcast(bounded.slice(0, int(np.searchsorted(np.cumsum(sizes), CACHE_BYTES)) + 1))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, min(MAX_TASKS, size // TASK_BYTES))
    parts = PARTS * tasks
    rare = rows.mapInArrow(lambda it: _rare(shared.value, pieces, chunk_bytes, parts)(it), "part int, chunk long, words string")
    asked = rare.repartition(tasks, "part").select("part", "chunk", F.explode(F.split("words", " ")).alias("word"))
    met = asked.groupBy("part", "word").agg(F.collect_list("chunk").alias("chunks"))
    words = _encode_runs(met, pieces).mapInArrow(_by_chunk(CHUNK_ENTRIES), "chunk long, words binary")
    blobs = rows.mapInArrow(_blobs(chunk_bytes), "chunk long, blob binary")
    out = "doc_id long, n_words long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return blobs.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(lambda a, b: _assemble(pieces, shared.value, with_ids)(a, b), out)


def decoded(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) of an encoding with ids; null ids decode to null."""
    raw = pieces.raw()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode(ids, raw) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    session(encoded)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
