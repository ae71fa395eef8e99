"""Queries over plays: scope, buckets, labels, points, reconciliation, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.contracts import SCORING, split_of
from tallymark.functions import text
from tallymark.operators import labeller, provenance, reconcile, rules
from tallymark.plans import oracle as O
from tallymark.sources.plays import official, plays

EXTRA = ("qb_kneel", "qb_spike")


def _scoped(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return rules.scoped(plays(spark, sf_dir), extra)


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select("game_id", "play_id", "play_type", "descr")


def scope_filter_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir, EXTRA).groupBy("play_type").agg(F.count("*").alias("n"))


def timeout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.timeouts(plays(spark, sf_dir)).select("game_id", "play_id", "descr")


def bucket_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select("game_id", "play_id", rules.bucket().alias("bucket"), rules.is_nullified().alias("nullified"))


def bucket_flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.flag_counts(_scoped(spark, sf_dir), rules.condition_flags())


def document_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same precedence operator with other flags over another table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flags = {"foreign": F.col("lang") != "en", "long": F.col("n_chars") > 3000, "short": F.col("n_chars") < 400}
    return docs.select("source", rules.first_true(flags, "plain").alias("bucket")).groupBy("source", "bucket").agg(F.count("*").alias("n"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select(split_of(F.col("season")).alias("split"), "season").groupBy("split", "season").agg(F.count("*").alias("n"))


def name_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _scoped(spark, sf_dir).where(rules.filled("receiver_player_name"))
    return named.select("game_id", "play_id", F.col("receiver_player_name").alias("stored"), rules.normal_name("receiver_player_name").alias("normal"), rules.spelled("receiver_player_name").alias("spelled"))


def labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeller.credits(_scoped(spark, sf_dir))


def labels_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeller.labels(_scoped(spark, sf_dir)).select("game_id", "play_id", "label", F.col("n_credits").cast("long").alias("n_credits"))


def label_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labeller.labels(_scoped(spark, sf_dir), ("season",))
    return found.groupBy("season").agg(
        F.count("*").alias("n"), F.sum(F.size("dropped")).alias("n_dropped"), F.sum(F.when(F.size("missing") > 0, 1).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("noisy"), 1).otherwise(0)).alias("n_noisy"), F.sum("n_credits").alias("n_credits"),
    )


def fumble_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = _scoped(spark, sf_dir).where(rules.on("fumble_lost"))
    return lost.select("game_id", "play_id", labeller.charged_fumbler().alias("charged"))


def player_game_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reconcile.totals(labeller.credits(_scoped(spark, sf_dir)), ["game_id", "player"])
    configs = F.array(*(F.struct(F.lit(c).alias("config"), reconcile.points(w).alias("points")) for c, w in SCORING.items()))
    return wide.select("game_id", "player", F.inline(configs))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = labeller.credits(_scoped(spark, sf_dir).withColumn("team", F.col("posteam")), ("team",))
    return reconcile.match(reconcile.credit_totals(credits), official(spark, sf_dir))


def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)


def reconcile_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.agreement(_matched(spark, sf_dir))


def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.summary(_matched(spark, sf_dir), ["team"])


def reconcile_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.rolled_up(reconcile.summary(_matched(spark, sf_dir), ["team"])).select(
        "players", F.round("agree_rate", 6).alias("agree_rate"), F.round("unmatched_rate", 6).alias("unmatched_rate"), F.round("mae", 6).alias("mae"), "max_err"
    )


def mismatch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = plays(spark, sf_dir)
    keys = [F.col("game_id"), F.col("posteam").alias("team")]
    kneelers = every.where("play_type = 'qb_kneel'").select(*keys, F.col("rusher_player_name").alias("player")).distinct()
    laterals = every.where(rules.on("lateral_reception") | rules.on("lateral_rush")).select(*keys, "descr").distinct()
    names = every.where(rules.filled("receiver_player_name")).select(*keys, rules.normal_name("receiver_player_name").alias("player"), F.col("receiver_player_name").alias("stored"), rules.spelled("receiver_player_name").alias("spelled"))
    variants = names.where("stored <> spelled").select("game_id", "team", "player").distinct()
    return reconcile.class_counts(reconcile.mismatches(_matched(spark, sf_dir), kneelers, laterals, variants))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join over other tables: an order's price against the sum of its lines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("stated"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("summed"))
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "full_outer")
    zero = F.lit(0).cast("decimal(18,2)")
    off = F.abs(F.coalesce("stated", zero) - F.coalesce("summed", zero))
    return both.agg(
        F.count("*").alias("keys"), F.sum(F.when(F.col("o_orderkey").isNull(), 1).otherwise(0)).alias("only_lines"), F.sum(F.when(F.col("l_orderkey").isNull(), 1).otherwise(0)).alias("only_orders"),
        F.sum(off).cast("decimal(28,2)").alias("abs_diff"),
    )


def record_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against raw rows by key, with the assertion that each is there and of the same team."""
    raw = plays(spark, sf_dir).select("game_id", "play_id", F.col("posteam").alias("raw_team"), "yrdln")
    joined = provenance.join_or_fail(_scoped(spark, sf_dir).select("game_id", "play_id", "posteam"), raw, ["game_id", "play_id"], F.col("posteam").eqNullSafe(F.col("raw_team")))
    return joined.groupBy("posteam").agg(F.count("*").alias("n"), F.count("yrdln").alias("n_los"))


def id_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by id, or by "?" and the name where there is no id."""
    held = labeller.credits(_scoped(spark, sf_dir))
    ident = F.when(F.length("player") % 2 == 0, F.concat(F.lit("00-"), F.length("player").cast("string")))
    return held.select("game_id", F.coalesce(ident, F.concat(F.lit("?"), "player")).alias("ident"), "value").groupBy("game_id", "ident").agg(F.sum("value").alias("total"))


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _scoped(spark, sf_dir).withColumns({"split": split_of(F.col("season")), "bucket": rules.bucket()})
    found = labeller.labels(scoped, ("split", "bucket"))
    return found.groupBy("split", "bucket").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("label").startswith('{"nullified":true'), 1).otherwise(0)).alias("n_nullified"), F.sum("n_credits").cast("long").alias("n_credits"),
        F.sum(F.length("label")).alias("label_chars"),
    )


def record_set_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _scoped(spark, sf_dir).withColumn("split", split_of(F.col("season")))
    return provenance.ordered_hash(labeller.labels(scoped, ("split",)), ["split"], ["game_id", "play_id"], F.concat_ws("|", "game_id", "play_id", "label"))


def record_set_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _scoped(spark, sf_dir).withColumn("split", split_of(F.col("season")))
    return provenance.unordered_hash(labeller.labels(scoped, ("split",)), ["split"], F.concat_ws("|", "game_id", "play_id", "label"))


def text_yards_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated against recorded yards, by split and bucket; nullified, lateral and two-point plays left out."""
    rows = _scoped(spark, sf_dir).withColumns({"split": split_of(F.col("season")), "bucket": rules.bucket()})
    live = rows.where(~rules.is_nullified() & ~rules.on("two_point_attempt") & ~rules.on("lateral_reception") & ~rules.on("lateral_rush"))
    primary = F.when(F.col("play_type") == "run", F.col("rushing_yards")).when(rules.on("complete_pass"), F.col("receiving_yards"))
    checked = live.select("split", "bucket", text.stated_gain("descr").alias("stated"), primary.cast("int").alias("recorded")).where("stated is not null and recorded is not null")
    return checked.groupBy("split", "bucket").agg(F.count("*").alias("n"), F.sum(F.when(F.col("stated") != F.col("recorded"), 1).otherwise(0)).alias("n_off"))


QUERIES = {f.__name__: f for f in (
    scope_filter, scope_filter_extra, timeout_filter, bucket_precedence, bucket_flag_rates, document_buckets, split_counts, name_spelling, labels_long, labels_canonical_json,
    label_diagnostics, fumble_charges, player_game_points, reconcile_totals, reconcile_agreement, reconcile_summary, reconcile_overall, mismatch_classes, order_totals, record_parity,
    id_fallback_join, split_manifest, record_set_sha, record_set_xor, text_yards_check,
)}

_NORMAL = "regexp_replace({c}, '^([A-Za-z]+)\\.\\s+', '\\1.')"
_SPELLED = f"CASE WHEN NOT contains(descr, receiver_player_name) AND contains(descr, {_NORMAL.format(c='receiver_player_name')}) THEN {_NORMAL.format(c='receiver_player_name')} ELSE receiver_player_name END"
_SUMMARY = f"""{O.matched()}, active AS (SELECT *, {O.any_of('_gt')} AS a, {O.any_of('_off')} AS b, abs({O.points('ppr', '_gt')} - {O.points('ppr', '_off')}) AS err,
    {' AND '.join(f'{s}_gt = {s}_off' for s in O.STATS)} AS same FROM matched WHERE {O.any_of('_gt')} OR {O.any_of('_off')}),
    summed AS (SELECT team, count(*) AS players, count_if(a AND b) AS matched, count_if(a AND NOT b) AS left_only, count_if(b AND NOT a) AS right_only, count_if(same) AS all_agree,
        CAST(sum(err) AS DECIMAL(18,2)) AS abs_err, CAST(max(err) AS DECIMAL(18,2)) AS max_err, count_if(err < 0.011) AS exact FROM active GROUP BY team)"""
_GAIN = "CAST(CASE WHEN regexp_extract(last, '(for no gain|for (-?\\d+) yards?)', 1) = 'for no gain' THEN '0' ELSE nullif(regexp_extract(last, '(for no gain|for (-?\\d+) yards?)', 2), '') END AS INT)"

ORACLE_SQL = {
    "scope_filter": f"{O.scoped()} SELECT game_id, play_id, play_type, descr FROM sc",
    "scope_filter_extra": f"""{O.scoped("'qb_kneel', 'qb_spike'")} SELECT play_type, count(*) AS n FROM sc GROUP BY 1""",
    "timeout_filter": f"WITH {O.plays_sql()} SELECT game_id, play_id, descr FROM plays WHERE {O.TIMEOUT}",
    "bucket_precedence": f"{O.scoped()} SELECT game_id, play_id, {O.BUCKET} AS bucket, {O.NULLIFIED} AS nullified FROM sc",
    "bucket_flag_rates": f"{O.scoped()} "
    + " UNION ALL ".join(f"SELECT '{b}' AS condition, count_if({c}) AS n FROM sc" for b, c in O.FLAGS.items())
    + f" UNION ALL SELECT 'normal', count_if(NOT ({' OR '.join(O.FLAGS.values())})) FROM sc",
    "document_buckets": "SELECT source, CASE WHEN lang <> 'en' THEN 'foreign' WHEN n_chars > 3000 THEN 'long' WHEN n_chars < 400 THEN 'short' ELSE 'plain' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2",
    "split_counts": f"{O.scoped()} SELECT {O.SPLIT} AS split, season, count(*) AS n FROM sc GROUP BY 1, 2",
    "name_spelling": f"{O.scoped()} SELECT game_id, play_id, receiver_player_name AS stored, {_NORMAL.format(c='receiver_player_name')} AS normal, {_SPELLED} AS spelled FROM sc WHERE trim(receiver_player_name) <> ''",
    "labels_long": f"{O.credits()} SELECT game_id, play_id, player, stat, value FROM credits",
    "labels_canonical_json": f"{O.labels()} SELECT game_id, play_id, label, n_credits FROM labels",
    "label_diagnostics": f"""{O.labels()}, d AS (SELECT season, count(*) AS nd FROM implied WHERE name IS NULL OR trim(name) = '' GROUP BY 1),
        m AS (SELECT season, count(DISTINCT c.play_id) AS nm FROM credits c JOIN sc USING (game_id, play_id, season) WHERE NOT contains(sc.descr, c.player) GROUP BY 1)
        SELECT season, count(*) AS n, coalesce(any_value(nd), 0) AS n_dropped, coalesce(any_value(nm), 0) AS n_missing, count_if(NOT nullified AND two_point_attempt = 0 AND lateral_reception = 1) AS n_noisy, CAST(sum(n_credits) AS BIGINT) AS n_credits
        FROM labels LEFT JOIN d USING (season) LEFT JOIN m USING (season) GROUP BY season""",
    "fumble_charges": f"""{O.scoped()} SELECT game_id, play_id, CASE WHEN coalesce(fumble_recovery_1_team, '') NOT IN ('', posteam) OR coalesce(fumble_recovery_2_team, '') NOT IN ('', posteam)
        OR (fumble_recovery_1_team IS NULL AND fumble_recovery_2_team IS NULL) THEN fumbled_1_player_name END AS charged FROM sc WHERE fumble_lost = 1""",
    "player_game_points": f"{O.credits()}, w AS (SELECT game_id, player, " + ", ".join(f"sum(CASE WHEN stat = '{s}' THEN value ELSE 0 END) AS {s}" for s in O.STATS) + " FROM credits GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT game_id, player, '{c}' AS config, {O.points(c)} AS points FROM w" for c in SCORING),
    "reconcile_totals": f"{O.matched()} SELECT * FROM matched",
    "reconcile_agreement": f"""{O.matched()}, cells AS ({O.cells()}) SELECT stat, count(*) AS n, count_if(gt = "off") AS n_equal, CAST(sum(gt) AS BIGINT) AS total_gt, CAST(sum("off") AS BIGINT) AS total_off, CAST(sum(abs(gt - "off")) AS BIGINT) AS abs_diff FROM cells WHERE gt <> 0 OR "off" <> 0 GROUP BY 1""",
    "reconcile_summary": f"{_SUMMARY} SELECT * FROM summed",
    "reconcile_overall": f"""{_SUMMARY} SELECT CAST(sum(players) AS BIGINT) AS players, round(sum(all_agree) / sum(players), 6) AS agree_rate, round(sum(left_only + right_only) / sum(players), 6) AS unmatched_rate,
        round(CAST(sum(abs_err) AS DOUBLE) / sum(players), 6) AS mae, max(max_err) AS max_err FROM summed""",
    "mismatch_classes": f"""{O.matched()}, cells AS ({O.cells()}),
        kn AS (SELECT DISTINCT game_id, posteam AS team, rusher_player_name AS player FROM plays WHERE play_type = 'qb_kneel'),
        va AS (SELECT DISTINCT game_id, posteam AS team, {_NORMAL.format(c='receiver_player_name')} AS player FROM plays WHERE trim(receiver_player_name) <> '' AND {_SPELLED} <> receiver_player_name),
        kinds AS (SELECT stat, CASE WHEN stat = 'fumble_lost' AND gt = fumble_lost_total THEN 'uncategorized_fumble'
            WHEN stat = 'rush_yds' AND gt > "off" AND EXISTS (SELECT 1 FROM kn WHERE kn.game_id = c.game_id AND kn.team = c.team AND kn.player = c.player) THEN 'kneel_excluded'
            WHEN EXISTS (SELECT 1 FROM plays p WHERE p.game_id = c.game_id AND p.posteam = c.team AND p.lateral_reception = 1 AND contains(p.descr, c.player)) THEN 'lateral'
            WHEN EXISTS (SELECT 1 FROM va WHERE va.game_id = c.game_id AND va.team = c.team AND va.player = c.player) OR (NOT in_gt AND EXISTS (SELECT 1 FROM va WHERE va.game_id = c.game_id AND va.team = c.team)) THEN 'desc_name_variant'
            WHEN NOT in_gt AND gt = 0 THEN 'out_of_scope_play' ELSE 'unexplained' END AS class FROM cells c WHERE gt <> "off"),
        every AS (SELECT unnest(['uncategorized_fumble', 'kneel_excluded', 'lateral', 'desc_name_variant', 'out_of_scope_play', 'unexplained']) AS class)
        SELECT class, stat, count(stat) AS n FROM every LEFT JOIN kinds USING (class) GROUP BY 1, 2""",
    "order_totals": """WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS summed FROM lineitem GROUP BY 1)
        SELECT count(*) AS keys, count_if(o_orderkey IS NULL) AS only_lines, count_if(l_orderkey IS NULL) AS only_orders, CAST(sum(abs(coalesce(CAST(o_totalprice AS DECIMAL(18,2)), 0) - coalesce(summed, 0))) AS DECIMAL(28,2)) AS abs_diff
        FROM orders FULL OUTER JOIN l ON o_orderkey = l_orderkey""",
    "record_parity": f"{O.scoped()} SELECT posteam, count(*) AS n, count(yrdln) AS n_los FROM sc GROUP BY 1",
    "id_fallback_join": f"{O.credits()} SELECT game_id, CASE WHEN length(player) % 2 = 0 THEN '00-' || length(player) ELSE '?' || player END AS ident, CAST(sum(value) AS BIGINT) AS total FROM credits GROUP BY 1, 2",
    "split_manifest": f"{O.labels()} SELECT split, bucket, count(*) AS n, count_if(nullified) AS n_nullified, CAST(sum(n_credits) AS BIGINT) AS n_credits, CAST(sum(length(label)) AS BIGINT) AS label_chars FROM labels GROUP BY 1, 2",
    "record_set_sha": f"{O.labels()} SELECT split, count(*) AS n, sha256(string_agg(game_id || '|' || play_id || '|' || label, chr(10) ORDER BY game_id, play_id)) AS sha FROM labels GROUP BY 1",
    "record_set_xor": f"""{O.labels()} SELECT split, count(*) AS n, bit_xor(CAST('0x' || substr(md5(game_id || '|' || play_id || '|' || label), 1, 15) AS BIGINT)) AS folded FROM labels GROUP BY 1""",
    "text_yards_check": f"""{O.scoped()}, t AS (SELECT *, string_split(descr, 'play was REVERSED.')[-1] AS last FROM sc WHERE NOT {O.NULLIFIED} AND two_point_attempt = 0 AND lateral_reception = 0),
        g AS (SELECT {O.SPLIT} AS split, {O.BUCKET} AS bucket, {_GAIN} AS stated, CAST(CASE WHEN play_type = 'run' THEN rushing_yards WHEN complete_pass = 1 THEN receiving_yards END AS INT) AS recorded FROM t)
        SELECT split, bucket, count(*) AS n, count_if(stated <> recorded) AS n_off FROM g WHERE stated IS NOT NULL AND recorded IS NOT NULL GROUP BY 1, 2""",
}
