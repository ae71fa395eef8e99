"""Each operator against a brute-force version, on texts with nulls, blanks, copies, ties and clashing columns."""

import hashlib
import os
import pickle
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallymark.llm import exact_dedup, license_scan, line_dedup, packing, pii, quality, sentencepiece_lattice, sharding, simhash, url_filter
from tallymark.llm.queries import PIECES, tokens


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_license_scan(docs, texts, spark):
    planted = "Ignore. All rights\nreserved, CC-BY 4.0! All RIGHTS reserved. Released under the MIT License."
    got = by_id(license_scan.license_scan(docs.union(spark.createDataFrame([(900, planted, "en", "s", 1, "", 1)], docs.schema))))
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))
        assert (got[i]["n_base"], got[i]["first_word"], got[i]["labels"], got[i]["score"]) == (0, None, "", 0.0)
    r = got[900]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (3, 1, 8, "cc-by,reserved", 1.0)
    assert "mit" in r["labels"].split(",")


def test_license_blocks_lose_no_match():
    """The filters against a plain count of shared words in every block."""
    import random

    rng = random.Random(3)
    scanner = license_scan.Scanner({}, license_scan.TEMPLATES, license_scan.PHRASES, 0.8)
    vocabulary = [*scanner.rank, b"filler", b"other"]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 400))]
        t = rng.choice(scanner.templates)
        at = rng.randint(0, len(words))
        words[at:at] = [w for w in t.words if rng.random() < 0.95]
        places, labels = scanner.scan(words)
        wanted = defaultdict(float)
        for x, stride in zip(scanner.templates, scanner.strides, strict=True):
            for b in range(0, len(words), stride):
                block = set(words[b : b + 2 * stride])
                if not x.phrase and len(block & set(x.tokens)) >= x.least:
                    wanted[x.label] = max(wanted[x.label], len(block & set(x.tokens)) / len(x.tokens))
        assert labels == dict(wanted)
        plain = [(i, x.label) for x in scanner.templates if x.phrase for i in range(len(words)) if words[i : i + len(x.words)] == x.words]
        assert sorted(places) == sorted(plain)


def test_license_templates_of_any_length_from_a_table(spark):
    """A template of 3,000 words is found in a text that holds it, from a table; its parts alone are not."""
    import random

    rng = random.Random(1)
    whole = " ".join(f"w{rng.randint(0, 900)}" for _ in range(3000))
    templates = license_scan.read_templates(spark.createDataFrame([("long", whole), ("long", "two words"), ("none", "..."), ("null", None)], "label string, text string"))
    assert set(templates) == {"long"} and len(templates["long"]) == 2
    rows = [(1, "before " * 2000 + whole + " after" * 10), (2, whole[:6000]), (3, "some two words"), (4, None)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), {"long": [whole]}))
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["long", "", "", ""]


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokens(), group_docs=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids, at = [*exact.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_packed_sequences_hold_the_ids(docs, texts):
    """The sequences, laid out from the pieces' ids, hold every document's ids."""
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    laid, found = defaultdict(dict), defaultdict(list)
    for r in packing.pack(docs, tokens(), group_docs=64).collect():
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        laid[r["sequence_id"]] |= {r["offset"] + k: x for k, x in enumerate(r["ids"])}
        found[r["doc_id"]].append((r["start"], r["sequence_id"], r["offset"], r["length"]))
    assert all(sorted(s) == list(range(len(s))) and len(s) <= 1024 for s in laid.values())
    for i, t in enumerate(texts):
        ids = [laid[s][at + k] for _, s, at, n in sorted(found[i]) for k in range(n)]
        assert ids == [*exact.encode(t or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "Grüße <|endoftext|>漢"])
def test_added_tokens_are_as_the_tokenizer_has_them(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens()(text.encode()) == exact.encode(text, add_special_tokens=False).ids


@pytest.fixture
def routed(monkeypatch):
    """Texts that the quick tokenizer got, in place of it."""

    got: list[str] = []

    class Quick:
        def encode_ordinary(self, text):
            got.append(text)
            return []

    monkeypatch.setattr(packing, "_quick", lambda *_: Quick())
    return got


LONG_RUN = re.compile(rb"[^\x09-\x0D ]{2000}|[\x09-\x0D ]{2000}")


def test_long_runs_go_to_the_slower_tokenizer(routed):
    tokenizer = tokens()
    for n in (1, 1998, 1999, 2000, 2001):
        for run in ("x" * n, "é" * (n // 2) + "x" * (n % 2), " \t\n\x0b\x0c\r" * (n // 6) + " " * (n % 6), "\x08" * n, "\x0e" * n):
            for text in (run, "a " + run + " a", " a" + run, run + "a ", "a" * 1998 + " " * 1998 + run):
                routed.clear()
                tokenizer(text.encode())
                assert bool(routed) == (not LONG_RUN.search(text.encode()))


def test_long_runs_are_found_across_windows():
    for n in (1999, 2000, 2001, 7000):
        for before in range(0, 9000, 97):
            text = (b"ab " * 3000)[:before] + b" " * (before % 2) + b"x" * n + b" " + b"ab " * 900
            assert packing.has_long_run(text, 2500) == packing.has_long_run(text) == bool(LONG_RUN.search(text))


def test_choosing_the_tokenizer_is_quick(routed):
    """It takes less than half of what a pattern of long runs takes alone, over words of a text."""
    text, tokenizer, spent = b"some words of a text, and others beside " * 50_000, tokens(), [[], []]
    for _ in range(5):
        for times, choose in zip(spent, (tokenizer, LONG_RUN.search), strict=True):
            began = time.process_time()
            choose(text)
            times.append(time.process_time() - began)
    assert len(routed) == 5 and min(spent[0]) < min(spent[1]) / 2


def test_packing_parts_repeated_rows_and_long_texts(spark):
    """One row over and over, and one very long text, are dealt to many groups."""
    rows = [(7, "the same row of words")] * 600 + [(8, "word " * 200_000), (None, "no id"), (None, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokens(), group_docs=64)
    groups = {i: {r["sequence_id"] >> 32 for r in found.where(f"doc_id = {i}").collect()} for i in (7, 8)}
    assert min(map(len, groups.values())) >= 8
    assert found.where("doc_id = 7").count() == 600 and found.where("doc_id is null").count() == 2


def test_packing_groups_follow_the_bytes(docs, monkeypatch):
    """Few long documents are not one group."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 4096)
    assert len({r["sequence_id"] >> 32 for r in packing.pack(docs, tokens()).collect()}) > 10


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 500)
    bins, offsets = packing.first_fit_decreasing(lengths)
    room, wanted = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(1024)
        wanted[i] = (k, 1024 - room[k])
        room[k] -= lengths[i]
    assert {i: (bins[i], offsets[i]) for i in range(500)} == wanted


def test_exact_dedup(docs, texts):
    rows = exact_dedup.exact_dedup(docs, bucket_bytes=2000, bucket_keys=4)
    got = by_id(rows)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lowered(t)].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    rows = [(1, "A text"), (1, "b text"), (5, "a text"), (5, "a text"), (5, "A TEXT"), (None, "n"), (None, "N"), (None, None), (7, "")]
    stay = [tuple(r) for r in exact_dedup.kept_rows(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((i or 0, lowered(t)) for i, t in stay) == [(0, "n"), (1, "b text"), (5, "a text"), (7, "")]
    kept = exact_dedup.kept_rows(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(max, groups.values()))
    assert kept.columns == docs.columns


def test_extendible_directory_splits_and_doubles():
    d = exact_dedup.Directory()
    d.split(0)
    d.split(1)
    assert (d.depth, d.slots) == (2, [0, 0, 1, 2])
    d.split(0)
    assert (d.depth, d.slots) == (2, [0, 3, 1, 2])
    keys = np.array([0, 1 << 62, 1 << 63, 3 << 62], dtype=np.uint64)
    assert d.lookup(keys).tolist() == [0, 3, 1, 2]


def test_dedup_chain_compares_bytes():
    """Texts whose keys collide are told apart."""
    import pyarrow as pa

    rows = [(0, 7, b"a", 1, 2), (0, 7, b"b", 5, 1), (0, 7, b"a", 9, 1), (0, 8, b"a2", 3, 1)]
    names = ["bucket", "h", "text", "keep_id", "n"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    out = [r for b in exact_dedup._resolve(iter([batch])) for r in b.to_pylist()]
    assert [(r["h"], r["keep_id"], r["group_size"]) for r in out] == [(7, 9, 3), (7, 5, 1), (8, 3, 1)]


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://x.net/éporn", "x.net", "/éporn", None, "block"),
        ("http://x.net/porn9", "x.net", "/porn9", None, "allow"),
        ("HTTP://A.B.ORG/x?y#z", "a.b.org", "/x", "org/", "allow"),
        ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", "com/de/", "block"),
        ("http://a.org", "a.org", "", None, "allow"),
        ("http://a.org?/x", "a.org", "", None, "allow"),
        ("http://x.net/free/pills", "x.net", "/free/pills", None, "block"),
        ("http://x.net/freepills", "x.net", "/freepills", None, "allow"),
        ("http://x.net/%63asino", "x.net", "/%63asino", None, "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ],
)
def test_url_filter(spark, url, host, path, rule, verdict):
    r = url_filter.url_filter(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")).first()
    assert tuple(r)[1:5] == (host, path, rule, verdict)


def test_url_vocabulary_from_a_table_and_its_sql(spark, tmp_path):
    import duckdb

    from tallymark.llm.queries import ORACLE_SQL, op4_url_filter

    table = spark.createDataFrame([("Bad", None), ("good", 1), ("fine", 1), ("best", 2), ("", 1), (None, 1)], "term string, weight int")
    strict, soft = url_filter.read_vocabulary(table)
    assert (strict, soft) == (["bad"], {"best": 2, "fine": 1, "good": 1})
    judge = lambda u: url_filter.url_filter(spark.createDataFrame([(1, u)], "page_id long, url string"), strict=strict, soft=soft).first()["verdict"]
    assert [judge(f"http://x.net/{p}") for p in ("bad", "good", "good/good", "good/fine", "best", "xbad", "ébad")] == ["block", "allow", "allow", "block", "block", "allow", "block"]
    urls = ["http://x.net/éporn", "http://x.net/pornö", "http://x.net/free-Pills", "http://x.net/free/free", "http://a.de/xxx9", "HTTP://X.NET/%58xx", None, "porn", "http://x.net/漢porn漢"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in op4_url_filter(spark, str(tmp_path)).collect())
    duckdb.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duckdb.execute(ORACLE_SQL["op4_url_filter"]).fetchall())


def counts_of(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, texts, spark):
    odd = ["a b c a b c a b", "#x $ %%\n#x $ %%\n\n", "one two one two one two one"]
    more = spark.createDataFrame([(500 + i, t, "en", "s", 0, "", 0) for i, t in enumerate(odd)], docs.schema)
    got = by_id(quality.quality_rules(docs.union(more)))
    assert len(got) == len(texts) + len(odd)
    for i, t in [*enumerate(texts), *((500 + i, t) for i, t in enumerate(odd))]:
        n = counts_of(t)
        assert tuple(got[i])[1:6] == n
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    import random

    rng = random.Random(2)
    sentence = lambda rng, n: " ".join("".join(rng.choice(["an", "ber", "co", "da", "el"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    clean = [sentence(rng, rng.randint(60, 200)) for _ in range(200)]
    junk = [" ".join(w + "###" for w in sentence(rng, 80).split()) for _ in range(20)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + junk)]
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(got[i]["kept"] for i in range(200))
    assert not any(got[i]["kept"] for i in range(200, 220))


@pytest.mark.parametrize("kind", ["lines", "words"])
def test_quality_rejects_what_repeats(spark, kind):
    """Many repeated lines alone, or many repeated words alone, where nobody else has any."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "ber", "co", "da", "el", "fi", "go"]) for _ in range(rng.randint(2, 4)))
    clean = [" ".join(word() for _ in range(rng.randint(80, 200))) for _ in range(200)]
    junk = []
    for _ in range(10):
        if kind == "lines":  # equal lines of two words: no window is found twice within one, and few across
            lines = [f"{word()} {word()}" for _ in range(40)]
            junk.append("\n".join([*lines, *rng.sample(lines, 20)]))
        else:
            words = [word() for _ in range(100)]
            junk.append(" ".join([*words, *words[:24], *(word() for _ in range(8))]))
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + junk)]
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(got[i]["kept"] for i in range(200))
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(200, 210))


def test_quality_keeps_namesakes_of_rejected_rows(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(1, good), (1, "short"), (None, good + " x"), (None, "short too"), (2, good), (2, good)]
    kept = [tuple(r) for r in quality.kept_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(1, good), (None, good + " x"), (2, good), (2, good)], key=str)


def test_covariance_step_matches_numpy(spark):
    """One estimate and its distances against numpy."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    rows = spark.createDataFrame([(i, "g", *map(float, r)) for i, r in enumerate(x)], "doc_id long, g string, x0 double, x1 double, x2 double, x3 double")
    fit = quality._estimates(rows, ["g"])
    got = {r["doc_id"]: r["d2"] for r in quality._distance(rows.join(fit, "g")).collect()}
    sigma = np.cov(x.T, bias=True) + np.diag(np.square(quality.NOISE))
    d = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(sigma), d)
    assert np.allclose([got[i] for i in range(80)], want, rtol=1e-8)


def test_sharding(docs, texts):
    rows = sharding.shard(docs, 8).collect()
    assert len(rows) == len(texts)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("ids", [4, 1])
def test_copies_fill_all_shards(spark, ids):
    """Equal texts under few ids, or one: every shard takes its part."""
    rows = spark.range(400).selectExpr(f"id % {ids} as doc_id", "'the same text' as text").coalesce(1)
    out = sharding.shard(rows, 40).collect()
    per = Counter(r["shard"] for r in out)
    assert len(per) == 40 and max(per.values()) - min(per.values()) <= 2
    for k in per:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(per[k]))


def test_shards_are_near_equal(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "repeat('ab', cast(id % 97 as int)) as text", "case when id % 3 = 0 then 'en' else 'fr' end as lang")
    sizes = [r["b"] for r in sharding.shard(rows, 40).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 40
    assert max(sizes) - min(sizes) <= 2 * (16 + 2 * 97)


def test_line_dedup(docs, texts):
    got = by_id(line_dedup.line_dedup(docs))
    seen, wanted, similar = [], defaultdict(list), 0
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").encode().translate(line_dedup._TABLE).split(b"\n")):
            words = frozenset(line.split())
            if not words:
                continue
            hits = [s for s in seen if 5 * len(s & words) >= 4 * len(s | words)]
            if hits:
                wanted[i].append(k)
                similar += words not in hits
            seen.append(words)
    assert similar > 3
    for i, t in enumerate(texts):
        assert (list(got[i]["removed"]), got[i]["n_lines"]) == (wanted[i], (t or "").count("\n") + 1)
    clean = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated_rows(docs).collect()}
    for i, t in enumerate(texts):
        assert clean[i] == (t if not wanted[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in wanted[i]))


def brute_removed(rows):
    """Lines that an equal or similar line precedes by (doc_id, line). rows: id, text."""
    seen, removed = [], defaultdict(list)
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").encode().translate(line_dedup._TABLE).split(b"\n")):
            if words := frozenset(line.split()):
                if any(5 * len(s & words) >= 4 * len(s | words) for s in seen):
                    removed[i].append(k)
                seen.append(words)
    return {i: removed[i] for i, _ in rows}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_line_dedup_of_rows_out_of_order(spark, texts, limit, monkeypatch):
    """One task reads a class late first; the line before it stays, and the similar one after it goes. By broadcast and shuffle."""
    import random

    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    rows = [(100, a), (5, a), (50, b)]
    read = lambda r: {x["doc_id"]: list(x["removed"]) for x in line_dedup.line_dedup(spark.createDataFrame(r, "doc_id long, text string").coalesce(1)).collect()}
    assert read(rows) == brute_removed(rows) == {5: [], 50: [0], 100: [0]}
    more = list(enumerate(texts))
    random.Random(1).shuffle(more)
    assert read(more) == brute_removed(more)


def test_line_dedup_of_clashing_and_null_ids(spark):
    """Rows that share an id are judged each for itself; rows without id come last."""
    a = "alpha beta gamma delta epsilon"
    rows = [(1, a), (2, a + "\nunique words stand here"), (2, "wholly other words in here"), (None, a + "\nfresh line of four"), (None, "fresh line of four")]
    got = {(r["doc_id"], r["text"]) for r in line_dedup.deduplicated_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    last = {t for i, t in got if i is None}
    assert got - {(None, t) for t in last} == {(1, a), (2, "unique words stand here"), (2, "wholly other words in here")}
    assert last in ({"fresh line of four", ""}, {"", "fresh line of four"}) and len([1 for i, _ in got if i is None]) == 2


@pytest.mark.parametrize("probed", [True, False])
def test_line_dedup_of_a_word_in_every_line(spark, probed, monkeypatch):
    """One word in all lines, its list dealt in cells; groups of near copies around the threshold, so that first candidates fail."""
    import random

    rng = random.Random(8)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    monkeypatch.setattr(line_dedup, "POSTINGS", 64)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    if not probed:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    words = [f"w{k}" for k in range(60)]
    lines = [" ".join(["common", *rng.sample(words[:6], 4)]) for _ in range(60)]
    for _ in range(6):
        base = rng.sample(words, 40)
        lines += [" ".join(["common", *(w if rng.random() > 0.1 else rng.choice(words) for w in base)]) for _ in range(20)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)]
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


def test_pii_formats():
    p = pii.Pseudonyms(b"k")
    text = "mail un.34@mail7.example.com, card 4539578763621486 and 4539 5787 6362 1486, not 4539578763621487, ip 10.0.0.1, not 999.1.1.1, tel +1 (017) 555-7713, on 2024-02-29 or 29.02.2024, not 2023-02-29, DE89370400440532013000, 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    new, counts = p.rewrite(text)
    assert counts == {"email": 1, "card": 2, "ip": 1, "phone": 1, "iso": 1, "day": 1, "iban": 1, "ssn": 1, "secret": 1}
    for gone in ("un.34@", "4539578763621486", "10.0.0.1", "555-7713", "2024-02-29", "DE89370400440532013000", "123-45-6789", "04dbebab"):
        assert gone not in new
    for stays in ("4539578763621487", "999.1.1.1", "2023-02-29", "mail7.example.com"):
        assert stays in new
    cards = re.findall(r"(?<=card )\d{16}|(?<=and )\d{4} \d{4} \d{4} \d{4}", new)
    assert cards[0] == cards[1].replace(" ", "")
    assert pii.luhn(cards[0][:-1]) == int(cards[0][-1])
    iso, day = re.search(r"on (\d{4})-(\d\d)-(\d\d) or (\d\d)\.(\d\d)\.(\d{4})", new).groups()[:3], re.search(r"or (\d\d)\.(\d\d)\.(\d{4})", new).groups()
    assert iso == day[::-1]
    assert p.rewrite(text) == (new, counts)
    assert p.rewrite(new)[1] == counts


def test_pii_neighbours():
    """Values side by side, and a value inside what looks like a longer one."""
    p = pii.Pseudonyms(b"k")
    new, counts = p.rewrite("Call +1 (826) 555-4081 190.137.223.204 or +49 30 1234 5678. 10.0.0.1, 10.0.0.2 4539578763621486 4539578763621487")
    assert counts == {"phone": 2, "ip": 3, "card": 1}
    assert not any(x in new for x in ("555-4081", "190.137", "1234 5678", "10.0.0.", "4539578763621486"))
    assert "4539578763621487" in new


@pytest.mark.parametrize("card", ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486"])
@pytest.mark.parametrize("after", [" 124", " 12/27", " 12-27", " 007 12", " CVV", ""])
def test_pii_card_before_numbers(card, after):
    new, counts = pii.Pseudonyms(b"k").rewrite(f"card {card}{after}.")
    assert counts == {"card": 1}
    assert card not in new and new.endswith(f"{after}.")
    assert new == pii.Pseudonyms(b"k").rewrite(f"card {card}")[0] + f"{after}."


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947"])
@pytest.mark.parametrize("after", [" BIC", " BIC COBADEFFXXX", " 123", " A B C 1 2 3", " FOR ALL OF THESE CAPITALS AND MORE", ""])
def test_pii_iban_before_capitals(iban, after):
    new, counts = pii.Pseudonyms(b"k").rewrite(f"to {iban}{after}.")
    assert counts == {"iban": 1}
    assert iban not in new and new.endswith(f"{after}.")
    assert new == pii.Pseudonyms(b"k").rewrite(f"to {iban}")[0] + f"{after}."


def test_pii_goes_on_behind_a_shorter_match():
    new, counts = pii.Pseudonyms(b"k").rewrite("4539578763621486 124 DE89370400440532013000 NO9386011117947 4539578763621487 12")
    assert counts == {"card": 1, "iban": 2}
    assert "4539578763621487 12" in new


def test_feistel_is_a_permutation_without_fixed_values():
    f = pii.Feistel(b"key")
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(f(i, size, "t") for i in range(size)) == list(range(size))
        assert all(f(f(i, size, "t"), size, "t", back=True) == i for i in range(size))
        assert size == 1 or all(f(i, size, "t") != i for i in range(size))


def test_pii_changes_every_value():
    """Short local parts and all dates: none stays, none meets another."""
    p = pii.Pseudonyms(b"k")
    local = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in ["", *"abcdefghijklmnopqrstuvwxyz"]]
    new = [p.rewrite(f"{x}@x.org")[0].partition("@")[0] for x in local]
    assert all(a != b for a, b in zip(local, new, strict=True)) and len(set(new)) == len(local)
    days = [f"{y}-{m:02d}-{d:02d}" for y in range(2000, 2004) for m in range(1, 13) for d in range(1, 29)]
    new = [p.rewrite(x)[0] for x in days]
    assert all(a != b for a, b in zip(days, new, strict=True)) and len(set(new)) == len(days)


@pytest.mark.parametrize("found", ["(555) 123-4567", "555-123-4567", "(555)123-4567", "555.123.4567"])
def test_pii_national_phones(found):
    p = pii.Pseudonyms(b"k")
    new, counts = p.rewrite(f"call {found}, not 055-123-4567 or 1555-123-4567 or 555-123.4567.")
    assert counts == {"national": 1} and f"call {found}" not in new
    assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {found}, not 055-123-4567 or 1555-123-4567 or 555-123.4567.")


@pytest.mark.parametrize("unit", ["x", "x.", "1", "1-", "a@", "DE89 ", "+1 ", "key=", ". ", "é"])
def test_pii_is_linear_in_a_text(unit):
    """A run of twice the length takes about twice the time."""
    import time

    p, took = pii.Pseudonyms(b"k"), []
    for size in (1 << 14, 1 << 15, 1 << 17):
        began = time.monotonic()
        p.rewrite(unit * (size // len(unit)) + " to me@mail.org")
        took.append(time.monotonic() - began)
    assert took[2] < 2 + 10 * took[1]


def test_pii_rows(docs, texts, empty):
    got = {r["doc_id"]: r for r in pii.rewritten_rows(docs, b"k").collect()}
    for i, t in enumerate(texts):
        new = None if t is None else pii.Pseudonyms(b"k").rewrite(t)[0]
        assert (got[i]["text"], got[i]["n_chars"], got[i]["keep_id"]) == (new, None if new is None else len(new), "x")


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return sentencepiece_lattice.Pieces.load(public_tokenizers.path(PIECES))


@pytest.mark.parametrize("cache", [0, 5, 100_000])
def test_sentencepiece_is_the_library(docs, texts, pieces, cache):
    import sentencepiece

    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    found = sentencepiece_lattice.encode(docs, pieces, cache_words=cache, chunk_bytes=3000)
    got = by_id(found)
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == library.encode(t or "")
        assert got[i]["round_trip"]
    assert {r["doc_id"]: r["text"] for r in sentencepiece_lattice.decoded(found, pieces).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_sentencepiece_query_gives_ids_that_decode(docs, texts, pieces, spark, tmp_path):
    from tallymark.llm.queries import op9_sentencepiece

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op9_sentencepiece(spark, str(tmp_path))
    assert all(r["round_trip"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in found.collect())
    assert {r["doc_id"]: r["text"] for r in sentencepiece_lattice.decoded(found, pieces).collect()} == {i: t or "" for i, t in enumerate(texts)}


ASSEMBLES = """
import pickle, sys
import pyarrow as pa
from tallymark.llm import sentencepiece_lattice as lattice
blobs, words, pieces, cache = pickle.load(open(sys.argv[1], "rb"))
put = lattice._assemble(pieces, cache, True)
open("/proc/self/clear_refs", "w").write("5")
kb = lambda key: int(open("/proc/self/status").read().split(key)[1].split()[0])
before = kb("VmRSS:")
found = put(blobs, words)
print((kb("VmHWM:") - before) // 1024, sum(found["n_words"].to_pylist()), max(len(b) for b in found.to_batches()))
"""


def test_sentencepiece_chunk_memory(pieces, tmp_path):
    """A full chunk of texts, where each word is another one, is put together in 450 MB beside its input, and its ids leave in parts."""
    rng, chunk = np.random.default_rng(3), sentencepiece_lattice.CHUNK_BYTES
    letters = rng.integers(97, 123, (chunk // 9, 9), dtype=np.uint8)
    letters[:, 8] = 32
    texts = [bytes(x).decode().rstrip() for x in np.array_split(letters.reshape(-1, 9), 3000)]
    blobs = [sentencepiece_lattice._press(pa.RecordBatch.from_pydict({"doc_id": [*range(250)], "text": texts[a : a + 250]})) for a in range(0, 3000, 250)]
    runs = pa.RecordBatch.from_pydict({"word": ["▁" + w for t in texts for w in t.split(" ")], "chunks": [[1]] * len(letters), "ids": pa.array([[9, 8, 7]] * len(letters), pa.list_(pa.int32()))})
    words = pa.Table.from_batches([*sentencepiece_lattice._by_chunk(1 << 18)(runs.slice(a, 16384) for a in range(0, len(letters), 16384))])
    none = pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    with open(tmp_path / "chunk", "wb") as f:
        pickle.dump((pa.table({"blob": pa.array(blobs, pa.binary())}), words, pieces, none), f)
    ran = subprocess.run([sys.executable, "-c", ASSEMBLES, str(tmp_path / "chunk")], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    grown, met, largest = map(int, ran.stdout.split())
    assert grown < 450 and met == len(letters) and largest == 250


def test_merging_by_aggregate_is_the_library(spark, pieces):
    """Words of random pieces, characters without piece, and runs of marks; none needs more than the one pass but the odd ones."""
    import random

    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    rng = random.Random(6)
    plain = [p.strip("▁") for p, ok in zip(pieces.pieces, pieces.plain, strict=True) if ok and p.strip("▁")]
    words = {"".join(rng.choices(plain, k=rng.randint(1, 4))) for _ in range(3000)} | {"".join(rng.choices("aeinrst", k=rng.randint(1, 20))) for _ in range(2000)}
    words |= {"\U0001f600", "x\u4dbfy", "\u0301a", "ÿ\x01", *("▁" * k + "ab" for k in range(2, 15)), *("▁" * k for k in range(2, 16))}
    words = {w for w in words if not pieces.in_place(w)}
    got = {r["word"]: list(r["ids"]) for r in sentencepiece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition(4), pieces).collect()}
    assert pieces.odd == ("▁" * 16,)
    assert got == {w: library.encode(sentencepiece_lattice.marked(w)[1:].replace("▁", " ")) for w in words}


def test_words_are_cut_where_no_piece_crosses(pieces):
    """Few runs in many words; the runs' ids are the words' in the library, marks, digits and characters without piece included."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    parts = ["Haus", "thnd", "дом", "ñosos", "x"]
    words = [a + gap + b for a in parts for b in parts for gap in (".\n", ",***", "7", "漢", "\u0301\u4dbf")]
    words += ["▁▁▁ab.", "▁▁", "12345", "─══─", "a-b", "\U0001f600é"]
    runs = pieces.runs(words)
    assert pieces.runs(["thnd.\nErer12"]) == ["▁thnd", ".", "\n", "Erer", "1", "2"] and pieces.runs(["▁▁▁ab."]) == ["▁▁▁ab", "."]
    assert "".join(runs) == "".join(map(sentencepiece_lattice.marked, words)) and len(set(runs)) < len(words) / 3
    table = pieces.table()
    for w in words:
        ids = [i for r in pieces.runs([w]) for i in sentencepiece_lattice.merge_long(r, pieces, table)]
        assert ids == library.encode(sentencepiece_lattice.marked(w)[1:].replace("▁", " "))
    classes = [{r for r in pieces.runs([p]) if r} for p, ok in zip(pieces.pieces, pieces.plain, strict=True) if ok]
    assert all(len(c) == 1 for c in classes)


def test_unigram_lattice_is_viterbi(spark):
    table = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.2, "ab": -3.1, "▁ab": -4.4, "ba": -2.9, "c": -5.0}
    pieces = sentencepiece_lattice.Pieces([*table, "<unk>"], [*table.values(), 0.0], [True] * len(table) + [False], sentencepiece_lattice.UNIGRAM, None, len(table))
    words = ["abab", "a", "bba", "cabz", "z"]
    got = {r["word"]: list(r["ids"]) for r in sentencepiece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    lookup = {p: (s, i) for i, (p, s) in enumerate(table.items())}
    assert got == {w: sentencepiece_lattice._viterbi_long("▁" + w, pieces, lookup) for w in words}


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts):
    got = by_id(simhash.simhash_components(docs))
    prints = [brute_fingerprint(t) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    low[i] = low[j] = min(low[i], low[j])
    for i in range(len(texts)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", low[i])


def test_simhash_of_null_and_repeated_ids(spark):
    rows = [(7, "a b c d"), (None, "a b c d"), (None, "x y z q"), (None, "x y z q"), (3, "k l m n"), (3, "K L M N"), (3, "other words than those"), (3, "other words than those")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(frame).collect())
    assert got == {(7, 7): 1, (None, 7): 1, (None, None): 2, (3, 3): 4}
    kept = sorted((str(i), t.lower()) for i, t in map(tuple, simhash.kept_rows(frame).collect()))
    assert kept == [("3", "k l m n"), ("3", "other words than those"), ("7", "a b c d"), ("None", "x y z q")]


@pytest.mark.parametrize("size", [3, 4, 5])
def test_covering_loses_no_link(size):
    from itertools import combinations

    sets = [set(s) for s in simhash.covering(size)]
    assert all(any(s <= set(shared) for s in sets) for shared in combinations(range(8), 5))


def test_links_of_dense_fingerprints(spark):
    rng = np.random.default_rng(0)
    near = [int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(120)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in [*near, *(int(x) for x in rng.integers(0, 1 << 62, 100))]})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_component_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i, 1000 - i) for i in range(n)], "fp long, low long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 10)], "a long, b long")
    got = {r["fp"]: r["low"] for r in simhash.components(nodes, pairs).collect()}
    assert got == {i: 1000 - (n - 10) if i <= n - 10 else 1000 - i for i in range(n)}


def test_empty_tables(spark, empty, pieces):
    pages = spark.createDataFrame([], "page_id long, url string")
    for out in (
        license_scan.license_scan(empty), packing.pack(empty, tokens()), exact_dedup.exact_dedup(empty), url_filter.url_filter(pages), quality.quality_rules(empty), sharding.shard(empty),
        line_dedup.line_dedup(empty), pii.pseudonymise(empty, b"k"), sentencepiece_lattice.encode(empty, pieces), simhash.simhash_components(empty),
    ):
        assert out.count() == 0


def test_repeated_rows(spark, pieces):
    twice = spark.createDataFrame([(1, "same text here\nand a line of some words"), (1, "same text here\nand a line of some words"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(twice).collect()) == [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True)]
    assert [r["component_id"] for r in simhash.simhash_components(twice).orderBy("doc_id").collect()] == [1, 1, 2]
    assert packing.pack(twice, tokens()).groupBy("doc_id").count().orderBy("doc_id").collect()[0]["count"] == 2
    assert [r["n_removed"] for r in line_dedup.line_dedup(twice).collect()] == [0, 0, 0]
    assert sharding.shard(twice, 2).count() == license_scan.license_scan(twice).count() == sentencepiece_lattice.encode(twice, pieces).count() == 3


@pytest.mark.parametrize("operator", [quality.quality_rules, sharding.shard])
def test_native_operators_run_no_python(docs, operator):
    plan = operator(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan.replace("LogicalRDD", ""))
