"""Queries that score predictions, resample, sample, filter noisy labels and gate releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.contracts import BUCKETS, split_of
from tallymark.functions import labels_json, parser, spots, text
from tallymark.operators import bootstrap, distill, labeller, labeller_v2, metrics, registry, retrieval, rules, sampling
from tallymark.plans import oracle as O
from tallymark.plans.shared import stash
from tallymark.plans.shipping import ship
from tallymark.sources import mock
from tallymark.sources.plays import plays

PLAY = ["game_id", "play_id"]


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scoped(plays(ship(spark), sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _scoped(spark, sf_dir)
    return rows.select(*PLAY, rules.bucket().alias("bucket"), rules.is_nullified().alias("nullified")), labeller.credits(rows)


def _scored(spark: SparkSession, sf_dir: str, system: str = "a") -> DataFrame:
    gold_plays, gold = _gold(spark, sf_dir)
    told, pred = mock.predictions(gold_plays, gold, system)
    return metrics.scored_plays(told, gold, pred)


def multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*PLAY, "tp", "fp", "fn", "exact", "valid", "strict")


def game_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.game_sums(_scored(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def bucket_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.bucket_metrics(_scored(spark, sf_dir)), *metrics.RATIOS)


def game_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_plays, gold = _gold(spark, sf_dir)
    _, pred = mock.predictions(gold_plays, gold, "a")
    return metrics.game_errors(gold, pred)


def validation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = ship(spark).range(1).select(F.inline(F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(float(i + 1)).alias("share")) for i, b in enumerate(BUCKETS)))))
    return _rounded(metrics.validation_scores(_scored(spark, sf_dir), shares), "micro", "macro", "natural", "f1")


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = stash(metrics.game_sums(_scored(spark, sf_dir)), "sums")
    return _rounded(bootstrap.intervals(sums, 1000), "point", "lo", "hi")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (stash(metrics.game_sums(_scored(spark, sf_dir, s)), "sums") for s in "ab")
    return bootstrap.paired(a, b, 500)


def paired_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_paired(spark, sf_dir), "diff", "lo", "hi")


def arm_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.verdict(_paired(spark, sf_dir))


def row_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of labels by a bootstrap whose clusters are single rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("game_id"), F.lit("all").alias("bucket"), F.col("quality").alias("exact"))
    zeros = {c: F.lit(0) for c in bootstrap.SUMS if c not in ("n", "exact")}
    found = bootstrap.intervals(labels.withColumns({"n": F.lit(1), **zeros}), 200).where("metric = 'exact_match'")
    return _rounded(found.select("metric", "point", "lo", "hi"), "point", "lo", "hi")


def wilson_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    per = joined.groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return per.select("lang", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counts by stratum with a total row."""
    joined = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    return joined.rollup("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("wrong")).select(
        F.coalesce("lang", F.lit("total")).alias("stratum"), "n", "wrong", F.round(F.try_divide(F.col("wrong"), F.col("n")), 6).alias("error_rate")
    )


def nested_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return sampling.nested_prefixes(docs, ["doc_id"], [10, 50, 200, 1_000_000], 7)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return sampling.stratified(docs, "lang", ["doc_id"], sampling.water_fill(sampling.stratum_sizes(docs, "lang"), 120), 20240)


def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return sampling.stratified(docs, "lang", ["doc_id"], sampling.proportional(sampling.stratum_sizes(docs, "lang"), 100), 5)


def enriched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    given = sampling.enriched(sampling.stratum_sizes(docs, "lang"), 150, "es", "en")
    return sampling.stratified(docs, "lang", ["doc_id"], given, 11).groupBy("lang").agg(F.count("*").alias("n"))


def whole_group_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    return sampling.groups_and_top_up(turns, "conv_id", "role", ["conv_id", "turn"], 100, 60, 20241)


def whole_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.whole_groups(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", 200, 3)


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the eight most similar conversation turns; both sides whole."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((-1 - F.col("item_id")).alias("id"), F.lit("item").alias("grp"), "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.col("role").alias("grp"), "text")
    corpus = items.unionByName(turns)
    weighted = stash(retrieval.weights(retrieval.terms(corpus, "id", "text", ("grp",)), "id", corpus.count(), ("grp",)), "tfidf")
    return retrieval.top_k(weighted.where("grp = 'item'"), weighted, "id", "grp", 8)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir).withColumn("bucket", rules.bucket())
    return mock.teacher_samples(labeller.labels(rows, ("bucket", "descr")))


def _decisions(spark: SparkSession, sf_dir: str, **checks: bool) -> DataFrame:
    return distill.decisions(_samples(spark, sf_dir), PLAY, **checks)


def rejection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(*PLAY, *distill.CHECKS, "keep")


def rejection_filter_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distill.decisions(_samples(spark, sf_dir).where("sample = 0"), PLAY, yardage=False, names=False, agreement=False)
    return found.groupBy("keep").agg(F.count("*").alias("n"))


def drop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.drop_counts(_decisions(spark, sf_dir))


def filter_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir).withColumn("bucket", rules.bucket())
    truth = labeller.labels(rows, ("bucket",))
    return distill.precision(_decisions(spark, sf_dir).where("keep").select(*PLAY, "answer"), truth, PLAY)


def missing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _samples(spark, sf_dir)
    return distill.missing_samples(held, held, PLAY, 4)


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir).select(*PLAY)
    done = rows.where("play_id % 3 = 0").withColumn("config_hash", F.lit("c0ffee"))
    return distill.pending(rows, done, PLAY, "c0ffee")


def latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return distill.latest(events, ["user_id", "event_type"], ["event_id"])


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (1 + F.col("user_id") % 7).alias("units"))
    return distill.within_budget(events, ["event_id"], F.col("units"), F.lit(5000)).select("event_id", "spent")


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = [metrics.bucket_metrics(_scored(spark, sf_dir, s)).select(F.lit(f"model_{s}").alias("model"), F.lit("sha").alias("sha"), "bucket", "n", F.round("exact_match", 6).alias("exact_match"), F.round("valid_rate", 6).alias("valid_rate")) for s in "ab"]
    both = stash(parts[0].unionByName(parts[1]), "models")
    return both, both.where("model = 'model_a'").drop("model")


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, now = _models(spark, sf_dir)
    return registry.gate(candidates, now, min_valid=0.9)


def gate_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, now = _models(spark, sf_dir)
    return registry.decision(registry.gate(candidates, now, min_valid=0.92))


def _release_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.when(F.col("event_id") % 5 < 2, "register").when(F.col("event_id") % 5 == 2, "promote").when(F.col("event_id") % 5 == 3, "reject").otherwise("rollback")
    return events.select(F.concat(F.lit("a"), "user_id").alias("adapter"), F.col("event_id").alias("at"), action.alias("action"), F.format_string("v%04d", 1 + F.col("event_id") % 4).alias("version"))


def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.states(_release_log(spark, sf_dir))


def registry_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.next_versions(_release_log(spark, sf_dir))


def json_extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs, some with prose around, some cut short, through the extractor and the strict validator."""
    found = labeller.labels(_scoped(spark, sf_dir))
    raw = F.when(F.col("play_id") % 5 == 0, F.concat(F.lit("Sure: "), "label", F.lit(" Done."))).when(F.col("play_id") % 5 == 1, F.expr("substring(label, 1, length(label) - 2)")).when(F.col("play_id") % 5 == 2, F.concat(F.lit("{x} "), "label")).otherwise(F.col("label"))
    read = found.select(*PLAY, "label", labels_json.parse_output(raw).alias("r"))
    return read.select(*PLAY, F.coalesce(labels_json.canonical("r.label") == F.col("label"), F.lit(False)).alias("same"), F.col("r.strict").alias("strict"), F.col("r.error").isNotNull().alias("failed"))


def parser_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir).withColumn("bucket", rules.bucket())
    found = labeller.labels(rows, ("bucket", "descr", "posteam"))
    parsed = found.withColumn("read", labels_json.canonical(parser.parse_play("descr", "posteam")))
    return parsed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.when(F.col("read") == F.col("label"), 1).otherwise(0)).alias("exact"))


def parser_los_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir).withColumn("bucket", rules.bucket())
    found = labeller.labels(rows, ("bucket", "descr", "posteam", "yrdln"))
    parsed = found.withColumn("read", labels_json.canonical(parser.parse_play_at("descr", "posteam", "yrdln")))
    return parsed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.when(F.col("read") == F.col("label"), 1).otherwise(0)).alias("exact"))


def spot_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plays(ship(spark), sf_dir).withColumn("los", spots.line_of_scrimmage())
    return rows.select(*PLAY, "los", spots.to_yardline("los", "posteam").alias("yardline"), spots.advance("los", F.col("z"), "posteam", "defteam").alias("ahead"), spots.gained("los", spots.advance("los", F.col("z"), "posteam", "defteam"), "posteam").alias("gained"))


def literal_spot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir).withColumn("kind", spots.spot_kind(spots.line_of_scrimmage(), "descr"))
    return rows.groupBy(split_of(F.col("season")).alias("split")).pivot("kind", ["literal", "goal_line", "computed"]).agg(F.count(F.lit(1))).fillna(0)


def v2_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yards to spots and back: each yardage credit from the line of scrimmage; how many come back as they were."""
    rows = _scoped(spark, sf_dir).withColumn("los", spots.line_of_scrimmage())
    credits = labeller.credits(rows, ("los", "posteam", "defteam")).where(F.col("stat").isin("pass_yds", "rush_yds", "rec_yds"))
    to = credits.withColumn("to", spots.advance("los", F.col("value"), "posteam", "defteam"))
    back = to.withColumn("back", spots.gained("los", "to", "posteam"))
    return back.groupBy("stat").agg(F.count("*").alias("n"), F.count("to").alias("on_field"), F.sum(F.when(F.col("back") == F.col("value"), 1).otherwise(0)).alias("same"))


def stated_yardage_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select(*PLAY, F.array_join(text.stated_yards("descr").cast("array<string>"), ",").alias("stated"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select(*PLAY, text.without_names("descr").alias("plain"))


def labels_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeller_v2.labels_v2(_scoped(spark, sf_dir))


def paired_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(_scored(spark, sf_dir, "a"), _scored(spark, sf_dir, "b"))


def regression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regressions(_scored(spark, sf_dir, "a"), _scored(spark, sf_dir, "b"))


def custom_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with a bonus from 100 yards on, which no sum of weights gives."""
    _, gold = _gold(spark, sf_dir)
    return metrics.custom_points(gold, lambda t: t.get("rush_yds", 0) / 2 + (8 if t.get("rush_yds", 0) >= 100 else 0))


QUERIES = {f.__name__: f for f in (
    multiset_prf, game_statistics, bucket_metrics, game_mae, validation_scores, cluster_bootstrap_ci, paired_diff_ci, arm_verdict, row_bootstrap, wilson_precision, audit_summary,
    nested_subset, balanced_sample, proportional_sample, enriched_sample, whole_group_topup, whole_group_limit, tfidf_topk, rejection_filter, rejection_filter_unfiltered, drop_stats,
    filter_precision, missing_samples, resume_pending, latest_entries, budget_prefix, gate_decision, gate_promotions, registry_state, registry_next_version, json_extract_validate,
    parser_exact_match, parser_los_exact_match, spot_arithmetic, literal_spot_kinds, v2_round_trip, stated_yardage_values, normalized_texts, labels_v2, paired_contingency, regression_filter, custom_score,
)}

_Y = "('pass_yds', 'rush_yds', 'rec_yds')"


_SPOT = "CASE WHEN {x} = 50 THEN '50' WHEN {x} = 100 THEN 'OPP 0' WHEN {x} < 50 THEN posteam || ' ' || {x} ELSE defteam || ' ' || (100 - {x}) END"


def _pred(s: str) -> str:
    kind = "play_id % 11" if s == "a" else "(play_id * 3 + 1) % 13"
    names = {0: "none", 1: "yards"} | ({2: "fewer", 3: "more", 4: "twice", 5: "nullified", 6: "prose"} if s == "a" else {})
    err = f"CASE {kind} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'right' END"
    by = 1 if s == "a" else 2
    return f"""pl_{s} AS (SELECT game_id, play_id, bucket, nullified, {err} AS err FROM labels),
        pc0_{s} AS (SELECT c.game_id, c.play_id, player, stat, CAST(value + CASE WHEN err = 'yards' AND stat IN {_Y} THEN {by} ELSE 0 END AS INT) AS value, err FROM credits c JOIN pl_{s} USING (game_id, play_id)
            WHERE err NOT IN ('none', 'nullified') AND NOT (err = 'fewer' AND stat = 'rec')),
        pc_{s} AS (SELECT game_id, play_id, player, stat, value FROM pc0_{s} UNION ALL SELECT game_id, play_id, player, stat, value FROM pc0_{s} WHERE err = 'twice' AND stat = 'rec'
            UNION ALL SELECT game_id, play_id, 'X.Extra', 'rush_yds', 5 FROM pl_{s} WHERE err = 'more'),
        g_{s} AS (SELECT game_id, play_id, player, stat, value, count(*) AS g FROM credits GROUP BY ALL), p_{s} AS (SELECT game_id, play_id, player, stat, value, count(*) AS p FROM pc_{s} GROUP BY ALL),
        m_{s} AS (SELECT game_id, play_id, sum(least(coalesce(g, 0), coalesce(p, 0))) AS tp, sum(greatest(coalesce(p, 0) - coalesce(g, 0), 0)) AS fp, sum(greatest(coalesce(g, 0) - coalesce(p, 0), 0)) AS fn
            FROM g_{s} FULL OUTER JOIN p_{s} USING (game_id, play_id, player, stat, value) GROUP BY 1, 2),
        sc_{s} AS (SELECT game_id, play_id, bucket, err <> 'none' AS valid, err NOT IN ('none', 'prose') AS strict, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn,
            err <> 'none' AND (err <> 'nullified' OR nullified) AND coalesce(fp, 0) = 0 AND coalesce(fn, 0) = 0 AS exact FROM pl_{s} LEFT JOIN m_{s} USING (game_id, play_id)),
        gs_{s} AS (SELECT coalesce(bucket, 'all') AS bucket, game_id, count(*) AS n, count_if(valid) AS valid, count_if(strict) AS strict_valid, count_if(exact) AS exact, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
            FROM sc_{s} GROUP BY GROUPING SETS ((game_id), (bucket, game_id)))"""


def _ratio(digits: int | None = 6) -> str:
    items = [f"CAST({a} AS DOUBLE) / nullif({b}, 0)" for a, b in metrics.RATIOS.values()]
    return ", ".join(f"{f'round({x}, {digits})' if digits else x} AS {m}" for m, x in zip(metrics.RATIOS, items, strict=True))


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in bootstrap.SUMS)


def _draws(boots: int, source: str) -> str:
    """w: boot, key, times drawn."""
    return f"""games AS (SELECT game_id, row_number() OVER (ORDER BY md5(game_id), game_id) - 1 AS idx FROM (SELECT DISTINCT game_id FROM {source})), gn AS (SELECT count(*) AS n FROM games),
        w AS (SELECT boot, idx, count(*) AS w FROM (SELECT id // n AS boot, CAST('0x' || substr(md5('0:' || (id // n) || ':' || (id % n)), 1, 8) AS BIGINT) % n AS idx
            FROM (SELECT n, unnest(range(n * {boots})) AS id FROM gn)) GROUP BY 1, 2)"""


def _boots(s: str) -> str:
    return f"bt_{s} AS (SELECT boot, bucket, " + ", ".join(f"sum(w * {c}) AS {c}" for c in bootstrap.SUMS) + f" FROM w JOIN games USING (idx) JOIN gs_{s} USING (game_id) GROUP BY 1, 2)"


def _unpivot(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, CAST({a} AS DOUBLE) / nullif({b}, 0) AS value FROM {source}" for m, (a, b) in metrics.RATIOS.items())


_PAIRED = f"""{O.labels()}, {_pred('a')}, {_pred('b')}, {_draws(500, 'gs_a')}, {_boots('a')}, {_boots('b')},
    ua AS ({_unpivot('bt_a', 'boot, bucket')}), ub AS ({_unpivot('bt_b', 'boot, bucket')}),
    ends AS (SELECT bucket, metric, quantile_cont(ub.value - ua.value, 0.025) AS lo, quantile_cont(ub.value - ua.value, 0.975) AS hi FROM ua JOIN ub USING (boot, bucket, metric) GROUP BY 1, 2),
    ta AS (SELECT bucket, {_SUMS} FROM gs_a GROUP BY 1), tb AS (SELECT bucket, {_SUMS} FROM gs_b GROUP BY 1), va AS ({_unpivot('ta', 'bucket')}), vb AS ({_unpivot('tb', 'bucket')}),
    diffs AS (SELECT bucket, metric, vb.value - va.value AS diff, lo, hi FROM va JOIN vb USING (bucket, metric) JOIN ends USING (bucket, metric))"""
_BUCKETS = lambda s: f"bm_{s} AS (SELECT *, {_ratio()} FROM (SELECT bucket, {_SUMS} FROM gs_{s} GROUP BY 1))"
_GATE = """checks AS (
    SELECT c.model, 'eval_file_match' AS "check", true AS passed, 'compared' AS reason FROM cand c WHERE bucket = 'all'
    UNION ALL SELECT model, 'valid_rate', valid_rate + 1e-9 >= {v}, 'compared' FROM cand WHERE bucket = 'all'
    UNION ALL SELECT model, 'min_exact_match', true, 'compared' FROM cand WHERE bucket = 'all'
    UNION ALL SELECT c.model, 'overall_exact_match', c.exact_match - a.exact_match + 1e-9 >= 0, 'compared' FROM cand c, bm_a a WHERE c.bucket = 'all' AND a.bucket = 'all'
    UNION ALL SELECT model, 'bucket_regression', count(bad) = 0, coalesce(string_agg(bad, ',' ORDER BY bad), '') FROM (
        SELECT m.model, CASE WHEN c.exact_match IS NULL OR (least(c.n, a.n) >= 30 AND a.exact_match - c.exact_match > 0.01 + 1e-9) THEN a.bucket END AS bad
        FROM (SELECT DISTINCT model FROM cand) m CROSS JOIN bm_a a LEFT JOIN cand c ON c.model = m.model AND c.bucket = a.bucket WHERE a.bucket <> 'all') GROUP BY 1)"""
_CAND = f"{O.labels()}, {_pred('a')}, {_pred('b')}, {_BUCKETS('a')}, {_BUCKETS('b')}, cand AS (SELECT 'model_a' AS model, * FROM bm_a UNION ALL SELECT 'model_b', * FROM bm_b)"
_RANK = "row_number() OVER (PARTITION BY lang ORDER BY sha256('{seed}:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS size"
_TURNS = f"""WITH t AS (SELECT conv_id, turn, role FROM conversations), g AS (SELECT conv_id, count(*) AS size FROM t GROUP BY 1),
    o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY sha256('{{seed}}:' || conv_id), CAST(conv_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)"""
_DECIDED = f"""{O.labels()}, dm AS (SELECT *, play_id % 7 AS mode, regexp_extract_all(descr, '(?i)\\bfor\\s+(-?\\d+)\\s+yards?', 1) AS said, contains(descr, 'for no gain') AS nogain FROM labels WHERE NOT nullified),
    wrongs AS (SELECT game_id, play_id, count(*) AS n_wrong FROM credits c JOIN dm USING (game_id, play_id) WHERE c.stat IN {_Y} AND NOT list_contains(said, CAST(c.value AS VARCHAR)) GROUP BY 1, 2),
    absent AS (SELECT DISTINCT game_id, play_id FROM credits c JOIN dm USING (game_id, play_id) WHERE NOT contains(descr, c.player)),
    dd AS (SELECT dm.*, mode <> 1 AS "schema", CASE WHEN mode <> 1 THEN coalesce(n_wrong, 0) = 0 AND mode <> 3 END AS yardage,
        CASE WHEN mode <> 1 THEN mode <> 4 AND a.play_id IS NULL AND (mode <> 3 OR contains(descr, 'V.Marlow')) END AS names, mode NOT IN (1, 2, 3) AS agreement
        FROM dm LEFT JOIN wrongs USING (game_id, play_id) LEFT JOIN absent a USING (game_id, play_id)),
    decided AS (SELECT *, "schema" AND coalesce(yardage, true) AND coalesce(names, true) AND agreement AND mode <> 1 AS keep,
        list_filter(['schema' || CASE WHEN "schema" THEN 'x' ELSE '' END, CASE WHEN yardage = false THEN 'yardage' END, CASE WHEN names = false THEN 'names' END, CASE WHEN NOT agreement THEN 'agreement' END], lambda x: x IS NOT NULL AND x <> 'schemax') AS failed FROM dd)"""

ORACLE_SQL = {
    "multiset_prf": f"{O.labels()}, {_pred('a')} SELECT game_id, play_id, tp, fp, fn, exact, valid, strict FROM sc_a",
    "game_statistics": f"{O.labels()}, {_pred('a')} SELECT * FROM gs_a",
    "bucket_metrics": f"{O.labels()}, {_pred('a')}, {_BUCKETS('a')} SELECT * FROM bm_a",
    "game_mae": f"""{O.labels()}, {_pred('a')}, w AS (SELECT unnest([{', '.join(f"{{'stat': '{s}', 'w': CAST({v} AS DECIMAL(4,2))}}" for s, v in O.SCORING['ppr'].items())}], recursive := true)),
        pts AS (SELECT game_id, player, sum(value * w) AS off FROM (SELECT game_id, player, stat, value FROM credits UNION ALL SELECT game_id, player, stat, -value FROM pc_a) JOIN w USING (stat) GROUP BY 1, 2)
        SELECT game_id, CAST(sum(abs(off)) AS DECIMAL(18,2)) AS abs_err, count(*) AS n_pairs FROM pts GROUP BY 1""",
    "validation_scores": f"""{O.labels()}, {_pred('a')}, per AS (SELECT bucket, count(*) AS n, count_if(exact) AS exact, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, CASE bucket {' '.join(f"WHEN '{b}' THEN {i + 1}.0" for i, b in enumerate(BUCKETS))} END AS share FROM sc_a GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(exact) / sum(n), 6) AS micro, round(avg(exact / n), 6) AS macro, round(CAST(sum(exact / n * share) AS DOUBLE) / CAST(sum(share) AS DOUBLE), 6) AS natural, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM per""",
    "cluster_bootstrap_ci": f"""{O.labels()}, {_pred('a')}, {_draws(1000, 'gs_a')}, {_boots('a')}, u AS ({_unpivot('bt_a', 'boot, bucket')}), e AS (SELECT bucket, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM u GROUP BY 1, 2),
        t AS (SELECT bucket, {_SUMS} FROM gs_a GROUP BY 1), v AS ({_unpivot('t', 'bucket')})
        SELECT bucket, metric, round(value, 6) AS point, CASE WHEN value IS NOT NULL THEN round(lo, 6) END AS lo, CASE WHEN value IS NOT NULL THEN round(hi, 6) END AS hi FROM v LEFT JOIN e USING (bucket, metric)""",
    "paired_diff_ci": f"{_PAIRED} SELECT bucket, metric, round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi FROM diffs",
    "arm_verdict": f"""{_PAIRED}, r AS (SELECT CASE WHEN bucket = 'all' AND coalesce(lo, -1) <= 0 THEN 'overall' WHEN bucket <> 'all' AND hi < 0 THEN bucket END AS reason FROM diffs WHERE metric = 'exact_match')
        SELECT count(reason) = 0 AS earned, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM r""",
    "row_bootstrap": f"""WITH src AS (SELECT CAST(doc_id AS VARCHAR) AS game_id, sum(quality) AS exact, count(*) AS n FROM labels GROUP BY 1), {_draws(200, 'src')}, b AS (SELECT boot, sum(w * exact) / sum(w * src.n) AS value FROM w JOIN games USING (idx) JOIN src USING (game_id) GROUP BY 1)
        SELECT 'exact_match' AS metric, round((SELECT avg(quality) FROM labels), 6) AS point, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM b""",
    "wilson_precision": """WITH per AS (SELECT lang, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / CAST(n AS DOUBLE) AS d FROM per)
        SELECT lang, k, n, round(greatest(0.0, (p + 1.96 * 1.96 / (2.0 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d), 6) AS lo, round(least(1.0, (p + 1.96 * 1.96 / (2.0 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d), 6) AS hi FROM p""",
    "audit_summary": "SELECT coalesce(lang, 'total') AS stratum, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS wrong, round(sum(toxic) / count(*), 6) AS error_rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
    "nested_subset": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS pos, count(*) OVER () AS total FROM documents) SELECT doc_id, pos, size FROM r CROSS JOIN (SELECT unnest([10, 50, 200, 1000000]) AS size) WHERE pos <= size AND size <= total",
    "balanced_sample": f"""WITH RECURSIVE r AS (SELECT doc_id, lang, {_RANK.format(seed=20240)} FROM documents), s AS (SELECT DISTINCT lang, size FROM r),
        lv AS (SELECT max(l) AS level FROM (SELECT unnest(range(0, 121)) AS l) WHERE (SELECT sum(least(size, l)) FROM s) <= 120),
        rest AS (SELECT 120 - (SELECT sum(least(size, level)) FROM s, lv) AS extra),
        given AS (SELECT lang, least(size, level) + CASE WHEN size > level AND row_number() OVER (PARTITION BY size > level ORDER BY lang) <= extra THEN 1 ELSE 0 END AS k FROM s, lv, rest)
        SELECT doc_id, lang FROM r JOIN given USING (lang) WHERE r <= k""",
    "proportional_sample": f"""WITH r AS (SELECT doc_id, lang, {_RANK.format(seed=5)} FROM documents), s AS (SELECT DISTINCT lang, size, 100.0 * size / (SELECT count(*) FROM documents) AS x FROM r),
        given AS (SELECT lang, least(size, greatest(1, CAST(floor(x) AS BIGINT))) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang) <= 100 - (SELECT sum(least(size, greatest(1, CAST(floor(x) AS BIGINT)))) FROM s) THEN 1 ELSE 0 END AS k FROM s)
        SELECT doc_id, lang FROM r JOIN given USING (lang) WHERE r <= k""",
    "enriched_sample": """WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), w AS (SELECT coalesce((SELECT size FROM s WHERE lang = 'es'), 0) AS k), o AS (SELECT * FROM s WHERE lang NOT IN ('es', 'en')),
        lv AS (SELECT max(l) AS level FROM (SELECT unnest(range(0, 151)) AS l) WHERE (SELECT sum(least(size, l)) FROM o) <= (SELECT greatest(0, 150 - k) FROM w)),
        given AS (SELECT lang, least(size, level) + CASE WHEN size > level AND row_number() OVER (PARTITION BY size > level ORDER BY lang) <= greatest(0, 150 - k) - (SELECT sum(least(size, level)) FROM o, lv) THEN 1 ELSE 0 END AS n FROM o, lv, w),
        rest AS (SELECT lang, n FROM given UNION ALL SELECT 'es', k FROM w WHERE k > 0)
        SELECT lang, CAST(n AS BIGINT) AS n FROM rest WHERE n > 0 UNION ALL SELECT 'en', CAST(least(size, (SELECT sum(n) FROM rest)) AS BIGINT) FROM s WHERE lang = 'en'""",
    "normalized_texts": f"""{O.scoped()} SELECT game_id, play_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(descr, '^\\(\\d{{0,2}}:\\d{{2}}\\)\\s*', ''),
        '\\b(?:[A-Z]{{2,3}}-)?\\d{{1,2}}-[A-Z][A-Za-z'']*\\. ?[A-Za-z][A-Za-z''\\-]*', ' PLAYER ', 'g'), '\\b[A-Z]{{2,3}} \\d{{1,2}}\\b', ' SPOT ', 'g'), '\\d+', '#', 'g') AS plain FROM sc""",
    "whole_group_topup": _TURNS.format(seed=20241)
    + """, core AS (SELECT t.* FROM t JOIN o USING (conv_id) WHERE before < 100), need AS (SELECT role, 60 - count(*) FILTER (WHERE c) AS k FROM (SELECT t.*, conv_id IN (SELECT conv_id FROM core) AS c FROM t) GROUP BY 1),
        pool AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY sha256('20241:' || conv_id || ':' || turn), conv_id, turn) AS r FROM t WHERE conv_id NOT IN (SELECT conv_id FROM core))
        SELECT conv_id, turn, role, 'group' AS part FROM core UNION ALL SELECT conv_id, turn, role, 'topup' FROM pool JOIN need USING (role) WHERE r <= k""",
    "whole_group_limit": _TURNS.format(seed=3) + " SELECT conv_id, size, CAST(before AS BIGINT) AS before FROM o WHERE before < 200",
    "tfidf_topk": """WITH c AS (SELECT -1 - item_id AS id, 'item' AS grp, text FROM benchmark UNION ALL SELECT conv_id * 10000 + turn, role, text FROM conversations), nn AS (SELECT count(*) AS n FROM c),
        ws AS (SELECT id, grp, regexp_extract_all(coalesce(text, ''), '[A-Za-z#]+') AS w FROM c),
        tm AS (SELECT id, grp, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM ws), tf AS (SELECT id, grp, term, count(*) AS tf FROM tm GROUP BY ALL),
        df AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, nn GROUP BY term), raw AS (SELECT id, grp, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN df USING (term)),
        nm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1), w AS (SELECT id, grp, term, raw / norm AS w FROM raw JOIN nm USING (id)),
        s AS (SELECT q.id AS id, d.id AS other, round(sum(q.w * d.w), 9) AS sim FROM w q JOIN w d USING (term) WHERE q.grp = 'item' AND d.grp <> 'item' GROUP BY 1, 2)
        SELECT id, other, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s) WHERE rank <= 8""",
    "rejection_filter": f'{_DECIDED} SELECT game_id, play_id, "schema", yardage, names, agreement, keep FROM decided',
    "rejection_filter_unfiltered": f"{O.labels()} SELECT play_id % 7 <> 1 AS keep, count(*) AS n FROM labels WHERE NOT nullified GROUP BY 1",
    "drop_stats": f"""{_DECIDED}, f AS (SELECT unnest(failed) AS "check", len(failed) AS n, failed[1] AS first FROM decided), e AS (SELECT unnest(['schema', 'yardage', 'names', 'agreement']) AS "check")
        SELECT e."check", count(f.n) AS failed, count_if(f.first = e."check") AS first, count_if(f.n = 1) AS sole FROM e LEFT JOIN f ON e."check" = f."check" GROUP BY 1""",
    "filter_precision": f"{_DECIDED} SELECT bucket, count(*) AS kept, count(*) AS evaluated, count(*) AS correct FROM decided WHERE keep GROUP BY 1",
    "missing_samples": f"{O.labels()} SELECT game_id, play_id, CASE WHEN play_id % 7 = 6 THEN [2, 3] ELSE [3] END AS missing FROM labels WHERE NOT nullified",
    "resume_pending": f"{O.scoped()} SELECT game_id, play_id FROM sc WHERE play_id % 3 <> 0",
    "latest_entries": "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2",
    "budget_prefix": "SELECT event_id, spent FROM (SELECT event_id, CAST(sum(1 + user_id % 7) OVER (ORDER BY event_id) AS BIGINT) AS spent FROM events) WHERE spent <= 5000",
    "gate_decision": f"{_CAND}, {_GATE.format(v=0.9)} SELECT * FROM checks",
    "gate_promotions": f"""{_CAND}, {_GATE.format(v=0.92)} SELECT model, bool_and(passed) AS promote, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE NOT passed), '') AS failed FROM checks GROUP BY 1""",
    "registry_next_version": """SELECT 'a' || user_id AS adapter, 'v' || lpad(CAST(coalesce(max(CASE WHEN event_id % 5 < 2 THEN 1 + event_id % 4 END), 0) + 1 AS VARCHAR), 4, '0') AS version FROM events GROUP BY 1""",
    "json_extract_validate": f"{O.labels()} SELECT game_id, play_id, play_id % 5 <> 1 AS same, play_id % 5 IN (3, 4) AS strict, play_id % 5 = 1 AS failed FROM labels",
    "spot_arithmetic": f"""WITH {O.plays_sql()} SELECT game_id, play_id, yrdln AS los, 100 - los_at AS yardline,
        CASE WHEN los_at + z = 50 THEN '50' WHEN los_at + z = 100 THEN 'OPP 0' WHEN los_at + z < 50 THEN posteam || ' ' || (los_at + z) ELSE defteam || ' ' || (100 - los_at - z) END AS ahead, z AS gained FROM plays""",
    "literal_spot_kinds": f"""{O.scoped()}, k AS (SELECT {O.SPLIT} AS split, CASE WHEN yrdln = '50' THEN regexp_matches(descr, '\\b(to|at|from|on|MID|[A-Z]{{2,3}}) 50\\b') ELSE regexp_matches(descr, '(^|[^A-Za-z0-9-])' || yrdln || '($|[^0-9])') END AS lit FROM sc)
        SELECT split, count_if(lit) AS literal, CAST(0 AS BIGINT) AS goal_line, count_if(NOT lit) AS computed FROM k GROUP BY 1""",
    "v2_round_trip": f"{O.credits()} SELECT stat, count(*) AS n, count(*) AS on_field, count(*) AS same FROM credits WHERE stat IN {_Y} GROUP BY 1",
    "paired_contingency": f"{O.labels()}, {_pred('a')}, {_pred('b')} SELECT a.exact AS a_right, b.exact AS b_right, count(*) AS n FROM sc_a a JOIN sc_b b USING (game_id, play_id) GROUP BY 1, 2",
    "regression_filter": f"{O.labels()}, {_pred('a')}, {_pred('b')} SELECT a.game_id, a.play_id FROM sc_a a JOIN sc_b b USING (game_id, play_id) WHERE a.exact AND NOT b.exact",
    "custom_score": f"{O.credits()}, t AS (SELECT game_id, player, CAST(coalesce(sum(value) FILTER (WHERE stat = 'rush_yds'), 0) AS DOUBLE) AS y FROM credits GROUP BY 1, 2) SELECT game_id, player, y / 2 + CASE WHEN y >= 100 THEN 8 ELSE 0 END AS points FROM t",
    "labels_v2": f"""{O.credits()}, c2 AS (SELECT c.game_id, c.play_id, c.player, c.stat, c.value, s.posteam, s.defteam, s.los_at,
            CASE WHEN c.stat = 'rec_yds' AND s.lateral_reception = 1 AND c.player = CASE WHEN s.lateral_receiver_player_name = 'R. Pell' THEN 'R.Pell' ELSE s.lateral_receiver_player_name END THEN s.los_at + CAST(s.receiving_yards AS INT) ELSE s.los_at END AS start
            FROM credits c JOIN sc s USING (game_id, play_id)),
        c3 AS (SELECT *, start + value AS stop FROM c2),
        c4 AS (SELECT *, {_SPOT.format(x='start')} AS from_, {_SPOT.format(x='stop')} AS to_ FROM c3),
        items AS (SELECT game_id, play_id, string_agg('{{"player":"' || player || '","stat":"' || stat || '",' || CASE WHEN stat IN {_Y} THEN CASE WHEN start <> los_at THEN '"from":"' || from_ || '",' ELSE '' END || '"to":"' || to_ || '"' ELSE '"value":' || value END || '}}', ','
            ORDER BY {O.ORD}, player, CASE WHEN stat IN {_Y} THEN 0 ELSE value END, CASE WHEN stat IN {_Y} AND start <> los_at THEN from_ ELSE '' END, CASE WHEN stat IN {_Y} THEN to_ ELSE '' END) AS items FROM c4 GROUP BY 1, 2)
        SELECT game_id, play_id, yrdln AS los, '{{"nullified":' || CASE WHEN {O.NULLIFIED} THEN 'true' ELSE 'false' END || ',"credits":[' || coalesce(items, '') || ']}}' AS label_v2, true AS round_trip, CAST(NULL AS VARCHAR) AS error
        FROM sc LEFT JOIN items USING (game_id, play_id)""",
    "stated_yardage_values": f"""{O.scoped()}, v AS (SELECT game_id, play_id, list_sort(list_distinct(list_transform(regexp_extract_all(descr, '(?i)\\bfor\\s+(-?\\d+)\\s+yards?', 1), lambda x: CAST(x AS INT)) || CASE WHEN contains(descr, 'for no gain') THEN [0] ELSE [] END)) AS l FROM sc)
        SELECT game_id, play_id, array_to_string(l, ',') AS stated FROM v""",
}
