"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency in the whole corpus, rarest first. Of a template with n different tokens, at least
o = ceil(threshold * n) must stand in a block. So one of its n - o + 1 rarest tokens must stand there (prefix filter); the block
must have o tokens (length filter); and no more can be shared than come after the meeting token in either order (positional
filter). What passes is verified. Only the templates' tokens can be shared, so blocks are projected on them first: the
templates, their vocabulary and the index on their prefixes are bounded by the template list, and go to every task.

A block is a stride of words and as many that follow, at every stride, so each passage of up to a stride of words lies whole in
one block. Templates may have any length: they are sorted by it into strides of STRIDE words, twice as many, and so on. Phrases are templates of threshold 1 whose words must stand consecutively; a place counts in the block in which it
starts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import session, text_bytes

STRIDE, THRESHOLD = 48, 0.9
MAX_TEMPLATES = 10_000
#: The phrases that a scan always counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "boost": ["boost software license version 1 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty "
        "of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
        "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license"],
}
#: Every byte that is not of a word to a blank, A-Z to a-z. Bytes from 0x80 are of characters that all count as letters.
_TABLE = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 0x7F else 0x20 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Template:
    """A template's tokens in the global order, and what the filters need."""

    def __init__(self, label: str, words: Sequence[bytes], threshold: float, phrase: bool, rank: Mapping[bytes, int]) -> None:
        self.label, self.words, self.phrase = label, list(words), phrase
        self.tokens = sorted(set(words), key=rank.__getitem__)
        self.least = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))
        self.prefix = self.tokens[: len(self.tokens) - self.least + 1]


class Scanner:
    """The templates under a global token order, with an inverted index on their prefixes."""

    def __init__(self, frequency: Mapping[bytes, int], templates: Mapping[str, Sequence[str]], phrases: Mapping[str, str], threshold: float, stride: int = STRIDE) -> None:
        split = [(label, words_of(t.encode()), threshold, False) for label, ts in templates.items() for t in ts]
        split += [(label, words_of(p.encode()), 1.0, True) for p, label in phrases.items()]
        if not all(words for _, words, _, _ in split):
            raise ValueError("a template must have a word")
        vocabulary = sorted({w for _, words, _, _ in split for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [Template(*x, self.rank) for x in split]
        self.strides = [stride << max(0, math.ceil(math.log2(len(t.words) / stride))) for t in self.templates]
        self.index: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, (t, size) in enumerate(zip(self.templates, self.strides, strict=True)):
            for i, token in enumerate(t.prefix):
                self.index.setdefault(size, defaultdict(list))[token].append((k, i))
        self.index = {size: dict(index) for size, index in self.index.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Phrases' places (start, label), and each matched template label with its best containment."""
        places: list[tuple[int, str]] = []
        labels: dict[str, float] = {}
        for stride, index in self.index.items():
            self._scan(words, stride, index, places, labels)
        return places, labels

    def _scan(self, words: list[bytes], stride: int, index: Mapping[bytes, list[tuple[int, int]]], places: list[tuple[int, str]], labels: dict[str, float]) -> None:
        met = [i for i, w in enumerate(words) if w in index]
        blocks = sorted({b for i in met for b in (i // stride, i // stride - 1) if b >= 0})
        for b in blocks:
            block = words[b * stride : (b + 2) * stride]
            order = sorted({w for w in block if w in self.rank}, key=self.rank.__getitem__)
            candidates: dict[int, bool] = {}
            for j, w in enumerate(order):
                for k, i in index.get(w, ()):
                    t = self.templates[k]
                    if k not in candidates and len(order) >= t.least:
                        candidates[k] = min(len(t.tokens) - i, len(order) - j) >= t.least
            inside = set(order)
            for k, passed in candidates.items():
                t = self.templates[k]
                if not passed or (shared := len(inside.intersection(t.tokens))) < t.least:
                    continue
                if not t.phrase:
                    labels[t.label] = max(labels.get(t.label, 0.0), shared / len(t.tokens))
                    continue
                n, anchor = len(t.words), t.words.index(t.tokens[0])
                for i, w in enumerate(block):
                    a = i - anchor
                    if w == t.tokens[0] and 0 <= a < stride and block[a : a + n] == t.words:
                        places.append((b * stride + a, t.label))


def read_templates(table: DataFrame) -> dict[str, list[str]]:
    """Templates of a table (label, text); at most MAX_TEMPLATES, as they go to every task."""
    rows = table.select("label", "text").where("text is not null").distinct().limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"a scan may have {MAX_TEMPLATES} templates")
    found: dict[str, list[str]] = {}
    for label, text in sorted(map(tuple, rows)):
        if words_of(text.encode()):
            found.setdefault(label, []).append(text)
    return found


def _count(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(w for w in words_of(text) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    return run


def _scan(scanner: Scanner):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                places, found = scanner.scan(words)
                starts, base = [a for a, _ in places], {label for _, label in places}
                score = 1.0 if base else max(found.values(), default=0.0)
                out.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {*found})), score))
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def license_scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Reads doc_id and text; other columns are ignored. A null text counts as empty: no words, no labels ("", not null), score
    0, and first_word and last_word null. A very long text is scanned block by block. The score is the best containment of a template, 1 with a phrase. Rows that repeat
    an id get a row each. An empty table gives no rows.
    """
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    vocabulary = frozenset(Scanner({}, templates, phrases, threshold).rank)
    counted = rows.mapInArrow(_count(vocabulary), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["token"]): r["n"] for r in counted.collect()}  # at most as many rows as the templates have tokens
    scanner = Scanner(frequency, templates, phrases, threshold)
    return rows.mapInArrow(_scan(scanner), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
