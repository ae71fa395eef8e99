"""Queries over identities, arms, views, metric files, routing and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import distill, labeller, reconcile, registry, rules, serving
from tallymark.plans import catalog_plays
from tallymark.plans import oracle as O
from tallymark.sources import files
from tallymark.sources.plays import official, plays

KEYS = ["game_id", "ident"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_ids(rows: DataFrame) -> DataFrame:
    """Players with an even number of letters have an id."""
    ident = F.when(F.length("player") % 2 == 0, F.concat(F.lit("00-"), F.substring(F.md5("player"), 1, 7)))
    return rows.withColumn("id", ident).withColumn("ident", reconcile.identity("id", "player"))


def id_keyed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rushing yards by our credits and by the official totals, joined on ids."""
    ours = labeller.credits(rules.scoped(plays(spark, sf_dir))).where("stat = 'rush_yds'").withColumn("player", rules.normal_name("player"))
    theirs = official(spark, sf_dir).where("rush_yds <> 0").withColumnRenamed("rush_yds", "value")
    return reconcile.match_by_id(_with_ids(ours), _with_ids(theirs), KEYS, "value")


def names_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.scoped(plays(spark, sf_dir)).where(rules.filled("receiver_player_name")).withColumn("ident", F.concat(F.lit("00-"), F.col("play_id") % 40))
    return reconcile.ambiguous_ids(rows, ["game_id", "posteam", "ident"], "receiver_player_name")


def explained_fumbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.explained(catalog_plays.reconcile_totals(spark, sf_dir))


def teacher_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.teacher_view(labeller.labels(rules.scoped(plays(spark, sf_dir)), ("posteam", "yrdln", "descr")))


def arms_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of events, of the users that have bought something expensive."""
    arms = _t(spark, sf_dir, "events").select(F.when((F.col("event_type") == "purchase") & (F.col("value") < 50), "cheap").otherwise(F.col("event_type")).alias("arm"), "user_id")
    return distill.common_to(arms, "arm", "purchase", ["user_id"]).groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    manifest = docs.where("doc_id % 7 = 3").agg(F.reverse(F.array_sort(F.collect_list("doc_id"))).alias("keys"))
    return distill.in_manifest_order(manifest, "keys", docs, "doc_id").select("at", "doc_id", "lang")


def metric_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as files hold them; those out of range, or of no form, count as bad."""
    n = F.format_string("%.3f", (F.col("event_id") % 1200) / 1000.0)
    forms = {0: n, 1: F.concat(F.lit('{"value": '), n, F.lit("}")), 2: F.concat(F.lit('{"point": '), n, F.lit(', "lo": 0}')), 3: F.concat(F.lit('{"mean": '), n, F.lit("}")), 4: F.lit('{"other": 1}')}
    form = F.col("event_id") % 5
    rows = _t(spark, sf_dir, "events").select(form.alias("form"), registry.metric_value(F.coalesce(*(F.when(form == k, v) for k, v in forms.items()))).alias("m"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("m").isNull()).alias("n_bad"), F.round(F.sum("m"), 3).alias("total"))


def routing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded slots against the batch's: every 97th is off, and every 89th was not recorded."""
    e = _t(spark, sf_dir, "events")
    batch = e.select("event_id", (F.col("user_id") % 8).alias("slot"))
    recorded = e.where("event_id % 89 <> 0").select("event_id", ((F.col("user_id") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)) % 8).alias("slot"))
    return serving.routing_faults(recorded, batch, ["event_id"], "slot")


def token_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _t(spark, sf_dir, "events").select("user_id", (F.col("user_id") % 16).alias("arm"), (F.col("event_id") / 8.0).alias("at"))
    return serving.token_gaps(tokens, "user_id", "at", ["arm"]).withColumns({c: F.round(c, 6) for c in ("p50", "p99")})


def adapter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of weights taken apart; every seventh isn't of an adapter."""
    pick = lambda i, *names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % (len(names) * i) / i).cast("int"))
    whole = F.concat(F.lit("base_model.model.model.layers."), F.col("event_id") % 24, F.lit(".self_attn."), pick(3, "q_proj", "k_proj", "v_proj", "o_proj"), F.lit(".lora_"), pick(2, "A", "B"), F.lit(".weight"))
    named = F.when(F.col("event_id") % 7 == 0, F.lit("base_model.model.embed_tokens.weight")).otherwise(whole)
    return _t(spark, sf_dir, "events").select(serving.adapter_key(named).alias("k")).groupBy("k.layer", "k.module", "k.side").agg(F.count("*").alias("n"))


def file_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.first_rows(_t(spark, sf_dir, "documents"), 25).select("doc_id", "lang", "n_chars")


QUERIES = {f.__name__: f for f in (
    id_keyed_totals, names_per_id, explained_fumbles, teacher_view, arms_in_common, manifest_order, metric_forms, routing_faults, token_gaps, adapter_keys, file_order_limit,
)}

_IDENT = "CASE WHEN length(player) % 2 = 0 THEN '00-' || substr(md5(player), 1, 7) ELSE '?' || player END"
_NAME = "regexp_replace(player, '^([A-Za-z]+)\\.\\s+', '\\1.')"

ORACLE_SQL = {
    "id_keyed_totals": f"""{O.credits()}, {O.official_sql()}, g0 AS (SELECT game_id, {_NAME} AS player, value FROM credits WHERE stat = 'rush_yds'),
        g AS (SELECT game_id, {_IDENT} AS ident, CAST(sum(value) AS BIGINT) AS v FROM g0 GROUP BY 1, 2), o AS (SELECT game_id, {_IDENT} AS ident, CAST(sum(rush_yds) AS BIGINT) AS v FROM official WHERE rush_yds <> 0 GROUP BY 1, 2)
        SELECT coalesce(g.game_id, o.game_id) AS game_id, coalesce(g.ident, o.ident) AS ident, coalesce(g.v, 0) AS gt, coalesce(o.v, 0) AS "off", g.ident IS NOT NULL AS in_gt, o.ident IS NOT NULL AS in_off
        FROM g FULL OUTER JOIN o ON g.game_id = o.game_id AND g.ident = o.ident""",
    "names_per_id": f"{O.scoped()} SELECT game_id, posteam, '00-' || (play_id % 40) AS ident, count(DISTINCT receiver_player_name) AS names FROM sc WHERE trim(receiver_player_name) <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT receiver_player_name) > 1",
    "explained_fumbles": f"{O.matched()} SELECT count(*) AS n, count_if(fumble_lost_gt = fumble_lost_off) AS n_equal, count_if(fumble_lost_gt = fumble_lost_off OR coalesce(fumble_lost_gt = fumble_lost_total, false)) AS n_explained FROM matched WHERE fumble_lost_gt <> 0 OR fumble_lost_off <> 0",
    "teacher_view": f"{O.scoped()} SELECT game_id, play_id, posteam, yrdln, descr FROM sc",
    "arms_in_common": """WITH a AS (SELECT CASE WHEN event_type = 'purchase' AND value < 50 THEN 'cheap' ELSE event_type END AS arm, user_id FROM events)
        SELECT arm, count(*) AS n, count(DISTINCT user_id) AS users FROM a WHERE user_id IN (SELECT user_id FROM a WHERE arm = 'purchase') GROUP BY 1""",
    "manifest_order": "SELECT CAST(row_number() OVER (ORDER BY doc_id DESC) - 1 AS INT) AS at, doc_id, lang FROM documents WHERE doc_id % 7 = 3",
    "metric_forms": """SELECT event_id % 5 AS form, count(*) AS n, count_if(event_id % 5 = 4 OR event_id % 1200 > 1000) AS n_bad, round(sum(CASE WHEN event_id % 5 <> 4 AND event_id % 1200 <= 1000 THEN (event_id % 1200) / 1000.0 END), 3) AS total FROM events GROUP BY 1""",
    "routing_faults": "SELECT event_id, user_id % 8 AS expected, CASE WHEN event_id % 89 <> 0 THEN (user_id + 1) % 8 END AS recorded FROM events WHERE event_id % 89 = 0 OR event_id % 97 = 0",
    "token_gaps": """WITH g AS (SELECT user_id % 16 AS arm, event_id / 8.0 - lag(event_id / 8.0) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events)
        SELECT arm, count(*) AS n, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.99), 6) AS p99 FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "adapter_keys": """SELECT CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 24 AS INT) END AS layer, CASE WHEN event_id % 7 <> 0 THEN ['q_proj', 'k_proj', 'v_proj', 'o_proj'][event_id % 12 // 3 + 1] END AS module,
        CASE WHEN event_id % 7 <> 0 THEN ['A', 'B'][event_id % 4 // 2 + 1] END AS side, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "file_order_limit": "SELECT doc_id, lang, n_chars FROM documents LIMIT 25",
}
