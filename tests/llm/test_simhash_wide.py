"""The near-duplicate stage's operator against shingles counted in plain Python."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from tallymark.llm import simhash_wide

from tests.llm.conftest import sentence


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / math.sqrt(len(x) * len(y))


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """60 texts of 60 to 400 words, each with copies of which up to one word in 35 differs, and a group of 150 near copies."""
    rng = random.Random(11)
    out = []
    for _ in range(60):
        base = sentence(rng, rng.randint(60, 400))
        n = len(base.split())
        out += [base, *(edited(rng, base, rng.randint(1, max(1, n // 35))) for _ in range(3))]
    hot = sentence(rng, 300)
    return out, [edited(rng, hot, 2) for _ in range(150)]


def found(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(7)
    return {r["doc_id"]: r["component_id"] for r in simhash_wide.near_components(frame).collect()}, frame


def test_recall_and_precision(spark, corpus):
    texts, hot = corpus
    every = texts + hot
    got, frame = found(spark, every)
    members = defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    assert all(c == min(m) for c, m in members.items())
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if a // 4 == b // 4 and alike(texts[a], texts[b]) >= 0.8]
    assert len(pairs) > 200
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert {got[i] for i in range(len(texts), len(every))} == {len(texts)}
    assert all(a // 4 == b // 4 for a, b in ((i, got[i]) for i in range(len(texts))))
    assert sorted(r["doc_id"] for r in simhash_wide.kept_rows(frame).collect()) == sorted(members)


def test_long_lists_lose_no_meeting(spark, corpus, monkeypatch):
    """Lists beyond the block give the same components as lists compared pair by pair."""
    texts, hot = corpus
    mixed = texts[:40] + hot[:60]
    whole, _ = found(spark, mixed)
    links, real = [], simhash_wide._across

    def seen(*args):
        links.append(1)
        return real(*args)

    monkeypatch.setattr(simhash_wide, "_across", seen)
    sizes = simhash_wide._meet

    def short(steps):
        run = sizes(steps)

        def with_short_lists(batches):
            from tallymark.llm import simhash_wide as there

            there.BLOCK = 2
            yield from run(batches)

        return with_short_lists

    monkeypatch.setattr(simhash_wide, "_meet", short)
    again, _ = found(spark, mixed)
    assert links
    assert again == whole


def test_odd_rows(spark, empty):
    long = " ".join(f"word{i % 90000}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c"), (4, "A b\nc"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (5, long), (6, long + " end"), (None, "only without id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash_wide.near_components(frame).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("3", "1"), ("None", "4"), ("4", "4"), ("4", "4"), ("4", "4"), ("None", "1"), ("5", "5"), ("6", "5"), ("None", "None")])
    kept = [(r["doc_id"], r["text"]) for r in simhash_wide.kept_rows(frame).collect()]
    assert sorted((str(i), (t or "")[:20]) for i, t in kept) == sorted([("1", ""), ("4", "A b\nc"), ("4", "a b c d e f"), ("5", long[:20]), ("None", "only without id")])
    assert simhash_wide.near_components(empty).count() == simhash_wide.kept_rows(empty).count() == 0


def test_a_hot_group_is_not_expanded(spark, monkeypatch):
    """Few pairs a text leave the lists, whatever the size of a group of near copies; their links still make one component."""
    rng = random.Random(3)
    hot = sentence(rng, 200)
    texts = [edited(rng, hot, rng.randint(1, 4)) for _ in range(400)]
    counts, real = [], simhash_wide.components

    def counted(nodes, pairs):
        counts.append(pairs.count())
        return real(nodes, pairs)

    monkeypatch.setattr(simhash_wide, "components", counted)
    got, _ = found(spark, texts)
    assert set(got.values()) == {0}
    assert max(counts) < len(texts)
