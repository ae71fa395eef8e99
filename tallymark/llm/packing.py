"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document is its token ids and one separator. Whole-capacity pieces are cut off its front; the remainder is one more piece.
Pieces are shuffled with their ids, and come out with ids, sequence and offset; checksums are of the ids that come out. Groups
are dealt by a hash of the piece, so a very long text goes to many; rows that repeat an id and a text are told apart by a number
within their input partition. The number of groups follows the rows and the bytes of text, and each group is packed alone, so no
task sees more than its group.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import session, text_bytes

CAPACITY, SEPARATOR, GROUP_DOCS = 1024, 0, 4096
#: Text of a group on average, so that long documents make more groups, not larger ones.
GROUP_BYTES = 64 << 20
#: First bytes of UTF-8 characters beyond U+024F. Such texts go to the slower tokenizer, whose idea of a letter rules.
_BEYOND_LATIN = re.compile(rb"[\xca-\xff]")
#: Texts with a run of so many bytes that are blank, or that are not, also go there: its merging is not quadratic in a run's length.
LONG_RUN, _BLANK = 2000, np.isin(np.arange(256), [*b"\t\n\x0b\x0c\r "])


@lru_cache(maxsize=4)
def _exact(model: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


@lru_cache(maxsize=4)
def _quick(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def has_long_run(text: bytes, window: int = 1 << 20) -> bool:
    """Whether LONG_RUN bytes in a row are blank, or are not. Windows overlap, and bound what is held beside a very long text."""
    for a in range(0, len(text) - LONG_RUN + 1, window):
        blank = _BLANK[np.frombuffer(text[a : a + window + LONG_RUN - 1], np.uint8)]
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        if np.diff(turns, prepend=-1, append=len(blank) - 1).max() >= LONG_RUN:
            return True
    return False


class Tokens:
    """Ids of a text under a vocabulary file of `tokenizers`. ranks: the same vocabulary as ranks, for Latin text; optional.

    Both give equal ids; texts go to the slower `tokenizers` where the quick one might differ or take long: beyond Latin letters, in
    very long runs, and where the string of an added token (as <|endoftext|>) stands. Files are read on the driver; executors get
    their content.
    """

    def __init__(self, model_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        with open(model_path, encoding="utf-8") as f:
            self.model = f.read()
        self.ranks, self.pattern = None, pattern
        self.added = tuple(t["content"].encode() for t in json.loads(self.model).get("added_tokens", []))
        if ranks_path and pattern:
            with open(ranks_path, "rb") as f:
                self.ranks = f.read()

    def encoder(self) -> Callable[[bytes], list[int]]:
        """What gives a text's ids. The tokenizers are looked up once for it, not for each text: their keys are whole vocabularies."""
        quick, exact = lru_cache(lambda: _quick(self.ranks, self.pattern)), lru_cache(lambda: _exact(self.model))

        def ids(text: bytes) -> list[int]:
            if self.ranks and not _BEYOND_LATIN.search(text) and not has_long_run(text) and not any(t in text for t in self.added):
                return quick().encode_ordinary(text.decode())
            return exact().encode(text.decode(), add_special_tokens=False).ids

        return ids

    def __call__(self, text: bytes) -> list[int]:
        return self.encoder()(text)


class TournamentTree:
    """Bins in order; each inner node holds the largest room below it, so the first bin with enough room is one descent away."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put length into the first bin that has room for it; returns the bin and its room before."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        before = room[i]
        room[i] = before - length
        at = i
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return at - self.leaves, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are 1 to capacity. Ties keep their order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = TournamentTree(n - full, capacity)
    for i in order[full:].tolist():
        at, before = tree.place(int(lengths[i]))
        bins[i], offsets[i] = full + at, capacity - before
    return bins, offsets


def _pieces(tokens: Tokens, capacity: int, separator: int):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "copy"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[tuple[int | None, int]] = Counter()
        encode = tokens.encoder()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), separator], dtype="<u4")
                n, row = len(ids), (doc_id, zlib.crc32(text))
                out += [(doc_id, a, min(capacity, n - a), ids[a : a + capacity].tobytes(), n, met[row]) for a in range(0, n, capacity)]
                met[row] += 1
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _ints(pieces: pa.ChunkedArray, lengths: np.ndarray) -> pa.ListArray:
    """Little-endian 32-bit ids as lists."""
    values = np.frombuffer(b"".join(x.as_py() for x in pieces), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def _pack(capacity: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(pieces: pa.Table) -> pa.Table:
        pieces = pieces.append_column("ids_crc32", pa.array([zlib.crc32(x.as_buffer()) for x in pieces["ids"]], pa.int64()))
        order = pc.sort_indices(pieces, [("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        pieces = pieces.take(order)
        lengths = pieces["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        sequences = (pieces["pack"].to_numpy().astype(np.int64) << 32) + bins
        found = pieces.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))
        return found.drop_columns(["ids"]).append_column("ids", _ints(pieces["ids"], lengths)).select(names)

    return run


def pack(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY, separator: int = SEPARATOR, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Reads doc_id and text; other columns are ignored. A null or empty text is one piece, the separator alone. A sequence is
    the ids of the pieces of one sequence_id, laid without gaps from offset 0. Rows that repeat an id are packed each for itself. A
    very long text is many pieces. The result doesn't depend on the order of the rows, and on how they are partitioned only where
    rows repeat both id and text. An empty table gives no rows.
    """
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-size["n"] // group_docs), -(-(size["bytes"] or 0) // GROUP_BYTES))
    pieces = rows.mapInArrow(_pieces(tokens, capacity, separator), "doc_id long, start long, length long, ids binary, doc_tokens long, copy int")
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "copy"), F.lit(groups))).drop("copy")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return dealt.groupBy("pack").applyInArrow(_pack(capacity), out)
