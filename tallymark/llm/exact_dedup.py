"""Exact dedup by an extendible-hash index on shared files.

The index key of a text is the first 64 bits of the SHA-256 of its normal form (A-Z lower-cased, nothing else). A directory
of 2^depth slots maps the key's leading bits to buckets. It starts as one slot; while a bucket is overfull it is split by its
next bit, and the directory doubles when the bucket already uses all bits of the directory. Bucket loads are distinct keys
(copies count once), so a hot text can't force splits that would not part it. The directory that all tasks share has at most
2^MAX_BITS slots, whatever the corpus; a bucket that is still overfull then is read by its owner in key order, so it need not fit.

Each bucket is a key range and has one owner task. It streams its entries in key order, chains texts that share a key,
and tells them apart by comparing bytes. Map tasks fold equal texts into one entry first, so a text that makes up a third of
the corpus reaches its owner once per map task. Resolved classes and the directory are written to the shared folder; the rows
learn their class by an equi-join that adaptive execution can split where a class is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import only_rows, row_hash, session, stash, text_bytes

#: Bytes and distinct keys that a bucket holds before it is split; bytes of distinct texts that a map task folds at a time.
BUCKET_BYTES, BUCKET_KEYS, FOLD_BYTES = 4 << 20, 1 << 18, 32 << 20
#: Bits of a key that one round of counting tells apart, and that the directory uses at most.
ROUND_BITS, MAX_BITS = 8, 16


class Directory:
    """The extendible directory: slots[i] is the bucket of the keys whose first `depth` bits are i."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = [0]
        self.buckets: list[tuple[int, int]] = [(0, 0)]  # local depth, prefix

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in (0, 1)]
        self.depth += 1

    def split(self, bucket: int) -> tuple[int, int]:
        """Split by the next bit; returns the two buckets, the first under the old number."""
        local, prefix = self.buckets[bucket]
        if local == self.depth:
            self.double()
        self.buckets[bucket] = (local + 1, prefix << 1)
        self.buckets.append((local + 1, prefix << 1 | 1))
        other, span = len(self.buckets) - 1, self.depth - local - 1
        first = (prefix << 1 | 1) << span
        self.slots[first : first + (1 << span)] = [other] * (1 << span)
        return bucket, other

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Buckets of unsigned 64-bit keys."""
        slots = np.asarray(self.slots, dtype=np.int32)
        return slots[(keys >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int32)


def build_directory(keys: DataFrame, bucket_bytes: int, bucket_keys: int) -> Directory:
    """Split overfull buckets until none is left, or MAX_BITS are used.

    keys: h (long), nbytes (long), one row for each distinct key. A round counts at most 2^ROUND_BITS prefixes below each
    overfull bucket; the driver sees those counts only, at most 2^MAX_BITS.
    """
    directory, bits = Directory(), 0
    overfull: list[int] | None = None
    while bits < MAX_BITS and overfull != []:
        bits += ROUND_BITS
        prefix = F.shiftrightunsigned("h", 64 - bits)
        rows = keys
        if overfull is not None:
            local = bits - ROUND_BITS
            rows = keys.where(F.shiftrightunsigned("h", 64 - local).isin([directory.buckets[b][1] for b in overfull]))
        loads = {r["p"]: (r["n"], r["b"]) for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), F.sum("nbytes").alias("b")).collect()}
        tree: dict[tuple[int, int], tuple[int, int]] = {}
        for p, (n, b) in loads.items():
            for d in range(bits, bits - ROUND_BITS - 1, -1):
                n0, b0 = tree.get((d, p >> (bits - d)), (0, 0))
                tree[d, p >> (bits - d)] = (n0 + n, b0 + b)
        todo = list(range(len(directory.buckets))) if overfull is None else overfull
        overfull = []
        while todo:
            bucket = todo.pop()
            n, b = tree.get(directory.buckets[bucket], (0, 0))
            if n > 1 and (n > bucket_keys or b > bucket_bytes):
                if directory.buckets[bucket][0] == bits:
                    overfull.append(bucket)
                else:
                    todo += directory.split(bucket)
    return directory


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(t.lower()).digest() for t in batch.column(1).to_pylist()]
        h = np.frombuffer(b"".join(x[:8] for x in shas), dtype=">i8").astype(np.int64)
        sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shas, pa.binary()), pa.array(h), sizes], ["doc_id", "raw", "sha", "h", "nbytes"])


def _fold(directory: Directory, fold_bytes: int):
    """Entries of the index: within a map task, equal texts are one entry (largest id, rows)."""

    def flush(seen: dict[bytes, list]) -> pa.RecordBatch:
        h = np.array([int.from_bytes(hashlib.sha256(t).digest()[:8], "big") for t in seen], dtype=np.uint64)
        ids, ns = [x[0] for x in seen.values()], [x[1] for x in seen.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(directory.lookup(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(list(seen), pa.binary()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())],
            ["bucket", "h", "text", "keep_id", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text.lower()
                if (entry := seen.get(text)) is None:
                    seen[text] = [doc_id, 1]
                    held += len(text) + 100
                else:
                    entry[1] += 1
                    if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                        entry[0] = doc_id
            if held > fold_bytes:
                yield flush(seen)
                seen, held = {}, 0
        if seen:
            yield flush(seen)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner task: entries come in key order; the chain holds the different texts of the current key."""
    chain: list[list] = []
    key, out = None, []

    def close() -> None:
        out.extend((bucket, key, hashlib.sha256(text).digest(), keep, n) for bucket, text, keep, n in chain)

    def emit() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "h", "class_sha", "keep_id", "group_size"])
        out.clear()
        return batch

    for batch in batches:
        for bucket, h, text, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != key:
                close()
                chain, key = [], h
            for entry in chain:
                if entry[1] == text:
                    entry[2] = max((x for x in (entry[2], keep) if x is not None), default=None)
                    entry[3] += n
                    break
            else:
                chain.append([bucket, text, keep, n])
        if len(out) > 4096:
            yield emit()
    close()
    if out:
        yield emit()


def _classed(docs: DataFrame, bucket_bytes: int, bucket_keys: int) -> DataFrame:
    """doc_id, raw (a hash of the text as it is), sha, keep_id and group_size of each row."""
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), row_hash(docs, "text").alias("raw"))
    keys = stash(rows.mapInArrow(_keys, "doc_id long, raw long, sha binary, h long, nbytes long"), "dedup-keys")
    distinct = keys.groupBy("h").agg(F.max("nbytes").alias("nbytes"))
    directory = build_directory(distinct, bucket_bytes, bucket_keys)
    entries = rows.select("doc_id", "text").mapInArrow(_fold(directory, FOLD_BYTES), "bucket int, h long, text binary, keep_id long, n long")
    owned = entries.repartitionById(len(directory.buckets), "bucket").sortWithinPartitions("h")
    classes = stash(owned.mapInArrow(_resolve, "bucket int, h long, class_sha binary, keep_id long, group_size long"), "dedup-index")
    return keys.join(classes.select("class_sha", "keep_id", "group_size"), F.col("sha") == F.col("class_sha"))


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Reads doc_id and text; other columns, whatever their names, are ignored. A null text counts as empty, and empty texts are
    equal. Of equal texts the largest doc_id stays; rows that repeat both id and text are one document and get the same
    verdict. A null doc_id stays only where its whole group has none. An empty table gives no rows.
    """
    return _classed(docs, bucket_bytes, bucket_keys).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: one of each class.

    Of rows that share the largest id, that whose text has the least hash stays; of rows that share the text too, any one. Only
    ids and hashes are joined; texts are neither sorted nor held.
    """
    kept = _classed(docs, BUCKET_BYTES, BUCKET_KEYS).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    alike = kept.groupBy("sha", "doc_id", "raw").agg(F.count("*").alias("n"))
    stay = alike.groupBy("sha").agg(F.min(F.struct("raw", "doc_id", "n")).alias("one")).select("one.*")
    return only_rows(docs, stash(stay, "dedup-stay"), "text")
