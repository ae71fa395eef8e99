"""URL filters: host rules, then a weighted vocabulary that one Aho-Corasick pass counts.

A rule names a host and a path; it fits the host and all subdomains where the url's path starts with the rule's, and the
longest rule wins. Where none fits, the whole url is lower-cased, its %XX escapes are decoded, and strict and soft terms are
counted where neither neighbour is one of 0-9 and a-z (other letters part words). Each term has a weight; one strict hit rejects, and
so do different soft terms whose weights come to SOFT_LIMIT. A vocabulary of any size can be read from a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import session

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
STRICT = (
    "bestiality", "bukkake", "camgirl", "camgirls", "casino", "casinos", "cheap-pills", "cialis", "creampie", "cumshot", "deepthroat", "escort", "escorts", "fetish", "gangbang", "hardcore", "hentai",
    "jackpot", "kamagra", "levitra", "malware", "milf", "paydayloan", "paydayloans", "phishing", "porn", "porno", "pornos", "pornstar", "scam-site", "slots", "spam-farm", "striptease", "tramadol", "viagra",
    "warez", "webcamsex", "xanax", "xnxx", "xvideos", "xxx",
)
#: Soft terms and their weights.
SOFT = {
    "adult": 1, "affiliate": 1, "amateur": 1, "babes": 1, "bet": 1, "bets": 1, "betting": 1, "bonus": 1, "cheap": 1, "click": 1, "coupon": 1, "crack": 1, "cracked": 1, "dating": 1, "deal": 1, "deals": 1,
    "discount": 1, "download": 1, "erotic": 1, "free": 1, "gambling": 1, "girls": 1, "hot": 1, "keygen": 1, "kostenlos": 1, "loan": 1, "loans": 1, "lottery": 1, "naked": 1, "nude": 1, "pharmacy": 1,
    "pills": 1, "poker": 1, "prize": 1, "promo": 1, "replica": 1, "roulette": 1, "serial": 1, "sex": 1, "sexy": 1, "spam": 1, "teen": 1, "torrent": 1, "win": 1, "winner": 1,
}
SOFT_LIMIT = 2
#: Terms that a vocabulary may have: the automaton goes to every task.
MAX_TERMS = 1_000_000
_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host is what follows the first `://` up to /, ?, # or the end; the path goes on up to ? or # or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    rest = rest[: min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


class Vocabulary:
    """An automaton over strict terms, and soft terms with weights."""

    def __init__(self, strict: Sequence[str], soft: Mapping[str, int]) -> None:
        self.automaton, self.soft = ahocorasick.Automaton(), dict(soft)
        for term in soft:
            self.automaton.add_word(term, (term, False))
        for term in strict:
            self.automaton.add_word(term, (term, True))
        self.any = bool(strict or soft)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int, int]:
        """Strict hits, different soft terms, and their weight."""
        text = unquote(url).translate(_LOWER)
        strict, soft = 0, set()
        for end, (term, is_strict) in self.automaton.iter(text) if self.any else ():
            start = end + 1 - len(term)
            if (start and text[start - 1] in _WORD) or text[end + 1 : end + 2] in _WORD:
                continue
            if is_strict:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft), sum(self.soft[t] for t in soft)


def read_vocabulary(terms: DataFrame) -> tuple[list[str], dict[str, int]]:
    """Strict and soft terms of a table (term, weight), lower-cased; a null weight is a strict term's. At most MAX_TERMS."""
    rows = terms.select(F.lower("term").alias("term"), F.col("weight").cast("int").alias("weight")).where("term <> ''").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary may have {MAX_TERMS} terms")
    strict = sorted(r["term"] for r in rows if r["weight"] is None)
    return strict, {r["term"]: r["weight"] for r in sorted(rows, key=lambda r: (r["term"], r["weight"] or 0)) if r["weight"] is not None and r["term"] not in set(strict)}


class Rules:
    """Rules by host; a host has as many candidates as labels."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def fit(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        parts = host.split(".")
        for i in range(len(parts)):
            for start, verdict in self.by_host.get(tail := ".".join(parts[i:]), ()):
                if path.startswith(start) and (best[0] is None or len(tail) + len(start) > len(best[0])):
                    best = (tail + start, verdict)
        return best


def _judge(rules: Rules, vocabulary: Vocabulary, soft_limit: int):
    names = ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms"]
    kinds = [pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = host_and_path(url)
                rule, verdict = rules.fit(host, path)
                strict, soft, weight = vocabulary.hits(url or "")
                out.append((page_id, host, path, rule, verdict or ("block" if strict or weight >= soft_limit else "allow"), strict, soft))
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null where none fits), verdict, strict_hits, soft_terms.

    Reads page_id and url; other columns are ignored. A null url, or one without ://, has an empty host and path; no rule fits
    it, and its terms are counted all the same. Rows that repeat an id are judged each for itself. Nothing is shuffled, so a hot host
    costs nothing. An empty table gives no rows.
    """
    session(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    out = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_terms long"
    return rows.mapInArrow(_judge(Rules(rules), Vocabulary(strict, soft), soft_limit), out)
