"""The queries of this subpackage, with production parameters, over whole tables; and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import exact_dedup, license_scan, line_dedup, packing, pii, quality, sentencepiece_lattice, sharding, simhash, url_filter
from tallymark.llm._shared import table

#: The setting that names the key of the pseudonyms. Without it a key that everybody knows is used: for public data and tests.
PII_KEY_SETTING, DEMONSTRATION_KEY = "spark.tallymark.pii.key", "tallymark demonstration key"
VOCABULARY, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def tokens() -> packing.Tokens:
    import public_tokenizers

    return packing.Tokens(public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(PII_KEY_SETTING, DEMONSTRATION_KEY).encode()


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = sentencepiece_lattice.Pieces.load(public_tokenizers.path(PIECES))
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), pieces)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_packing, op3_exact_dedup, op4_url_filter, op5_quality_rules, op6_sharding, op7_line_dedup, op8_pii, op9_sentencepiece, op10_simhash, pipeline)
}

def _url_sql() -> str:
    """Rules and terms again, each term tried at each place of the url."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    terms = ", ".join([*(f"('{t}', true, 0)" for t in url_filter.STRICT), *(f"('{t}', false, {w})" for t, w in url_filter.SOFT.items())])
    hits = "len(list_filter(range(1, length(u) + 1), lambda i: substr(u, i, length(t)) = t AND NOT regexp_matches(substr(' ' || u, i, 1), '[0-9a-z]') AND NOT regexp_matches(substr(u, i + length(t), 1), '[0-9a-z]')))"
    return f"""
        WITH rules(h, p, v) AS (VALUES {rules}), terms(t, strict, w) AS (VALUES {terms}),
        a AS (SELECT page_id, lower(url_decode(coalesce(url, ''))) AS u, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, u, lower(regexp_extract(rest, '^[^/]*')) AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM a),
        fit AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS ruled FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
        hits AS (SELECT page_id, CAST(coalesce(sum(CASE WHEN strict THEN n END), 0) AS BIGINT) AS strict_hits, count(CASE WHEN NOT strict AND n > 0 THEN 1 END) AS soft_terms, sum(CASE WHEN NOT strict AND n > 0 THEN w ELSE 0 END) AS weight
            FROM (SELECT page_id, strict, w, {hits} AS n FROM b JOIN terms ON contains(u, t)) GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hits > 0 OR weight >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_terms, 0) AS soft_terms
        FROM b LEFT JOIN fit USING (page_id) LEFT JOIN hits USING (page_id)
    """


ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": _url_sql(),
    "op3_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
}
