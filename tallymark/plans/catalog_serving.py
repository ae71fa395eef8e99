"""Queries over requests, pools, prefixes, training data and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import text
from tallymark.operators import labeller, rules, sampling, serving, training
from tallymark.plans import oracle as O
from tallymark.plans.shipping import ship
from tallymark.sources import files, predictors
from tallymark.sources.plays import plays

TENANTS = 16


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def zipf_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = serving.uniform(F.lit("zipf"), "event_id")
    return _t(spark, sf_dir, "events").groupBy(serving.assigned_tenant(u, TENANTS).alias("tenant")).agg(F.count("*").alias("n"))


def uniform_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = serving.uniform(F.lit("even"), "event_id")
    return _t(spark, sf_dir, "events").groupBy(serving.assigned_tenant(u, TENANTS, None).alias("tenant")).agg(F.count("*").alias("n"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    n = (F.col("event_id") % 7).cast("int")
    first = F.col("event_id") / 10.0 + (F.col("user_id") % 5 + 1) / 16.0
    done = F.when(F.col("event_id") % 19 != 0, first + (F.col("user_id") % 11) / 8.0)
    return e.select("event_id", (F.col("user_id") % TENANTS).alias("tenant"), (F.col("event_id") / 10.0).alias("arrival_s"), first.alias("first_token_s"), done.alias("finish_s"), n.alias("n_tokens"))


def goodput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.goodput(serving.latencies(_outcomes(spark, sf_dir), 0.25, 0.2), ["tenant"])
    return found.withColumns({c: F.round(c, 6) for c in ("attainment", "goodput", "tokens_per_s", "ttft_p50", "ttft_p99", "tpot_p50")})


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"))


def nearest_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.nearest_rank(_t(spark, sf_dir, "documents").select("source", "n_chars"), ["source"], "n_chars")


def workload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.workload(_outcomes(spark, sf_dir), "tenant", "n_tokens")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_length", "top_share")})


def arrival_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = serving.poisson_arrivals(_t(spark, sf_dir, "events").select("event_id"), "event_id", 2.0, 11)
    return placed.select("event_id", F.round("arrival_s", 5).alias("arrival_s"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").alias("pool"), "event_id", F.concat(F.lit("a"), F.col("event_id") * 7 % 13).alias("adapter"))
    both = F.array(F.struct((2 * F.col("event_id")).alias("seq"), F.lit("acquire").alias("action")), F.struct((2 * F.col("event_id") + 61).alias("seq"), F.lit("release").alias("action")))
    return e.select("pool", "adapter", F.inline(both)).select("pool", "seq", "adapter", "action")


def lru_pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.pool_statistics(serving.pool_outcomes(_actions(spark, sf_dir), 6, frozenset({"a0"})))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") % 4).alias("adapter"), F.col("conv_id").alias("request"), F.col("turn").alias("block"), F.col("text").alias("payload"))
    return serving.prefix_blocks(turns, "request", "block", "payload").withColumn("arrival", F.col("request"))


def prefix_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.prefix_hits(_blocks(spark, sf_dir), "request", "arrival", "block", ["adapter"])


def prefix_cache_hits_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.prefix_hits(_blocks(spark, sf_dir), "request", "arrival", "block", [])


def cross_adapter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.cross_audit(_blocks(spark, sf_dir), "adapter")


def batch_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 + 1).cast("int").alias("q"))
    return serving.batch_rows(turns, ["conv_id"], "turn", "q").select("conv_id", "turn", "row")


def arm_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.overhead(_t(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), "value"), "click")
    return found.withColumns({c: F.round(c, 6) for c in ("median", "low", "high", "overhead_pct")})


def capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ship(spark).range(1).select(F.explode(F.array(*map(F.lit, (0, 512, 2048)))).alias("kv_tokens"))
    shapes = ranks.select("kv_tokens", F.lit(2.5e9).alias("base_bytes"), F.lit(2.2e7).alias("adapter_bytes"), (F.col("kv_tokens") * 32768.0).alias("kv_bytes"))
    return serving.capacity(shapes, 8e10).select("kv_tokens", "merged", "resident")


def param_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("q", 2048, 2048, 16), ("k", 2048, 512, 16), ("v", 2048, 512, 16), ("o", 2048, 2048, 16), ("up", 2048, 8192, 32), ("down", 8192, 2048, 16)]
    cells = F.array(*(F.struct(F.lit(m).alias("module"), F.lit(a).cast("long").alias("n_in"), F.lit(b).cast("long").alias("n_out"), F.lit(c).cast("long").alias("copies")) for m, a, b, c in rows))
    return serving.lora_parameters(ship(spark).range(1).select(F.inline(cells)), 16)


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", text.tokens_estimated("text").cast("long").alias("tokens"), F.size(F.split("text", " ")).cast("long").alias("words"))


def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.batch_padding(_lengths(spark, sf_dir), "doc_id", "tokens", 16, 3, 8)


def completion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.sequence(F.lit(1), F.col("turn").cast("int") + 1), lambda i: i).alias("prompt"), F.array(F.lit(7), F.lit(8)).alias("completion"))
    labels = training.masked_labels(F.col("prompt"), F.col("completion"))
    wide = training.padded(labels, training.rounded_up(F.size(labels), 4), training.IGNORED)
    return turns.select("conv_id", "turn", F.array_join(wide.cast("array<string>"), " ").alias("labels"))


def token_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.token_shares(_lengths(spark, sf_dir), "tokens", "words", 64, ["lang"])


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.tokens_estimated("text").cast("long").alias("tokens"))


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, dropped = training.within_length(_lengths(spark, sf_dir), F.col("tokens"), 1000)
    return fits.withColumn("part", F.lit("fits")).unionByName(dropped.withColumn("part", F.lit("dropped"))).groupBy("part", "lang").agg(F.count("*").alias("n"), F.max("tokens").alias("longest"))


def epoch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.epoch_stream(_t(spark, sf_dir, "benchmark"), "item_id", 3, 16, 5)


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ship(spark).range(1000)
    return steps.select(F.col("id").alias("step"), F.round(training.learning_rate(F.col("id"), 2e-4, 50, 1000, 0.1) * 1e6, 6).alias("lr"))


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), ((F.col("event_id") * 37 + F.col("user_id")) % 101).alias("score"))


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.early_stop(_evals(spark, sf_dir), "run", "step", "score", 8)


def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _evals(spark, sf_dir).withColumn("tokens", (F.col("step") % 9 + 1))
    return training.log_windows(log, "run", "step", "score", "tokens", 500).withColumn("loss", F.round("loss", 6))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.run_summary(_evals(spark, sf_dir).withColumn("seconds", F.col("step") % 17), "run", "step", "score", "seconds")


def checkpoints_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.last_kept(_evals(spark, sf_dir).select("run", "step"), "run", "step", 5)


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    amounts = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("in"), (F.col("event_id") % 100 * 10).cast("double"), F.lit("out"), (F.col("user_id") % 50).cast("double"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    reported = F.when(F.col("event_id") % 3 == 1, (F.col("event_id") % 7) / 1000.0)
    usage = e.select("event_type", amounts.alias("amounts"), reported.alias("reported"), ((F.col("user_id") % 20) / 4.0).alias("latency_s"), F.lit(8).alias("batch_size"))
    return training.cost(usage, ["event_type"], {"in": 2.0, "out": 8.0}, 3.6).withColumns({c: F.round(c, 6) for c in ("seconds", "dollars", "dollars_per_1k")})


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scoped(plays(ship(spark), sf_dir)).select(text.record_key().alias("key"), text.user_turn("descr", "posteam", "yrdln").alias("prompt"))


def fewshot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"))
    found = training.few_shot(turns, "conv_id", "turn", "Read one play.")
    return found.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labeller.labels(rules.scoped(plays(ship(spark), sf_dir)).withColumn("bucket", rules.bucket()), ("bucket",))
    return files.manifest(found, ["bucket"], files.json_text(["game_id", "play_id", "label"]))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plays(ship(spark), sf_dir).select("game_id", "play_id", "descr", "play_type")
    return files.violations(rows, ["descr", "play_type"], {"play_type": ["pass", "run", "no_play"]}).groupBy("problem").agg(F.count("*").alias("n"))


def predictor_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor seam from end to end: batches, raw text, configuration hash."""
    rows = rules.scoped(plays(ship(spark), sf_dir))
    raw = predictors.predict(rows, predictors.RuleParser())
    truth = labeller.labels(rows)
    return raw.join(truth, ["game_id", "play_id"]).groupBy("config_hash").agg(F.count("*").alias("n"), F.sum(F.when(F.col("raw") == F.col("label"), 1).otherwise(0)).alias("exact"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of a fixed size, in the table's order."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified(docs.withColumn("all", F.lit("all")), "all", ["doc_id"], {"all": 100}, 9).select("doc_id", "lang")


QUERIES = {f.__name__: f for f in (
    zipf_assignment, uniform_assignment, goodput_summary, latency_percentiles, nearest_rank_summary, workload_stats, arrival_process, lru_pool_stats, prefix_cache_hits, prefix_cache_hits_unkeyed,
    cross_adapter_audit, batch_plan_rows, arm_overhead, capacity_table, param_table, batch_padding, completion_mask, token_shares, token_estimates, length_filter, epoch_stream, lr_schedule,
    early_stop, log_windows, run_summaries, checkpoints_dropped, cost_rollup, prompt_render, fewshot_messages, dataset_manifest, contract_violations, predictor_flow, hash_sample,
)}

_U = "CAST('0x' || substr(md5('{s}:' || event_id), 1, 8) AS BIGINT) / 4294967296.0"
_ENDS = ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in serving.zipf_weights(TENANTS))
_OUT = """o AS (SELECT event_id, user_id % 16 AS tenant, event_id / 10.0 AS arrival_s, event_id / 10.0 + (user_id % 5 + 1) / 16.0 AS first_token_s,
    CASE WHEN event_id % 19 <> 0 THEN event_id / 10.0 + (user_id % 5 + 1) / 16.0 + (user_id % 11) / 8.0 END AS finish_s, event_id % 7 AS n_tokens FROM events),
    l AS (SELECT *, first_token_s - arrival_s AS ttft, CASE WHEN n_tokens >= 2 THEN (finish_s - first_token_s) / (n_tokens - 1) END AS tpot FROM o),
    g AS (SELECT *, coalesce(finish_s IS NOT NULL AND ttft <= 0.25 AND coalesce(tpot <= 0.2, true), false) AS ok FROM l)"""
_BLOCKS = """b0 AS (SELECT conv_id % 4 AS adapter, conv_id AS request, turn AS block, md5(coalesce(text, '')) AS own FROM conversations),
    b AS (SELECT *, md5(string_agg(own, '') OVER (PARTITION BY request ORDER BY block)) AS chain FROM b0)"""


def _hits(by: str) -> str:
    keys = f"{by}, chain" if by else "chain"
    return f"""WITH {_BLOCKS}, f AS (SELECT {keys}, min(request) AS first FROM b GROUP BY ALL), s AS (SELECT request, block, first < request AS hit FROM b JOIN f USING ({keys}))
        SELECT request, count(*) AS blocks, coalesce(min(CASE WHEN NOT hit THEN block END), max(block) + 1) - min(block) AS hit_blocks FROM s GROUP BY 1"""


_LEN = "l AS (SELECT doc_id, lang, CAST(greatest(1, round_even(length(text) / 4.0, 0)) AS BIGINT) AS tokens, CAST(len(string_split(text, ' ')) AS BIGINT) AS words FROM documents)"
_EV = "v AS (SELECT user_id AS run, event_id AS step, (event_id * 37 + user_id) % 101 AS score FROM events)"

ORACLE_SQL = {
    "zipf_assignment": f"SELECT CAST(least(len(list_filter([{_ENDS}], lambda e: e <= {_U.format(s='zipf')})), 15) AS INT) AS tenant, count(*) AS n FROM events GROUP BY 1",
    "uniform_assignment": f"SELECT CAST(floor({_U.format(s='even')} * 16) AS INT) AS tenant, count(*) AS n FROM events GROUP BY 1",
    "goodput_summary": f"""WITH {_OUT} SELECT tenant, count(*) AS requests, count(finish_s) AS completed, count_if(ok) AS attained, round(count_if(ok) / count(*), 6) AS attainment,
        round(count_if(ok) / (max(arrival_s) - min(arrival_s)), 6) AS goodput, round(sum(CASE WHEN finish_s IS NOT NULL THEN n_tokens END) / (max(finish_s) - min(arrival_s)), 6) AS tokens_per_s,
        round(quantile_cont(ttft, 0.5), 6) AS ttft_p50, round(quantile_cont(ttft, 0.99), 6) AS ttft_p99, round(quantile_cont(tpot, 0.5), 6) AS tpot_p50 FROM g GROUP BY 1""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "nearest_rank_summary": """WITH r AS (SELECT source, list_sort(list(n_chars)) AS l FROM documents GROUP BY 1)
        SELECT source, len(l) AS n, round_even(list_avg(l), 1) AS mean, l[len(l) // 2 + 1] AS p50, l[CAST(floor(0.99 * (len(l) - 1)) AS BIGINT) + 1] AS p99, l[len(l)] AS max, CAST(list_sum(l) AS BIGINT) AS sum FROM r""",
    "workload_stats": f"WITH {_OUT}, p AS (SELECT tenant, count(*) AS n, sum(n_tokens) AS t FROM o GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS requests, round(sum(t) / sum(n), 6) AS mean_length, count(*) AS tenants, round(max(n) / sum(n), 6) AS top_share FROM p",
    "arrival_process": "SELECT event_id, round(sum(-ln(1 - CAST('0x' || substr(md5('11:' || event_id), 1, 8) AS BIGINT) / 4294967296.0) / 2.0) OVER (ORDER BY event_id), 5) AS arrival_s FROM events",
    "prefix_cache_hits": _hits("adapter"),
    "prefix_cache_hits_unkeyed": _hits(""),
    "cross_adapter_audit": f"WITH {_BLOCKS} SELECT chain, count(DISTINCT adapter) AS namespaces, count(*) AS blocks FROM b GROUP BY 1 HAVING count(DISTINCT adapter) > 1",
    "batch_plan_rows": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS row FROM (SELECT conv_id, turn, unnest(range(turn % 3 + 1)) AS k FROM conversations)",
    "arm_overhead": """WITH p AS (SELECT event_type AS arm, median(value) AS m, min(value) AS a, max(value) AS z FROM events GROUP BY 1)
        SELECT arm, round(m, 6) AS median, round(a, 6) AS low, round(z, 6) AS high, round(100 * (m - b) / b, 6) AS overhead_pct FROM p, (SELECT m AS b FROM p WHERE arm = 'click')""",
    "capacity_table": "SELECT k AS kv_tokens, CAST(floor(7.2e10 / (2.5e9 + k * 32768.0)) AS BIGINT) AS merged, CAST(floor((7.2e10 - 2.5e9) / (2.2e7 + k * 32768.0)) AS BIGINT) AS resident FROM (SELECT unnest([0, 512, 2048]) AS k)",
    "param_table": "SELECT CAST(16 * (4096 * 16 + 2560 * 16 + 2560 * 16 + 4096 * 16 + 10240 * 32 + 10240 * 16) AS BIGINT) AS trainable, t AS total, 16 * t AS full_bytes, 2 * t + 16 * CAST(16 * (4096 * 16 + 2560 * 16 + 2560 * 16 + 4096 * 16 + 10240 * 32 + 10240 * 16) AS BIGINT) AS lora_bytes FROM (SELECT CAST(2048 * 2048 * 32 + 2048 * 512 * 32 + 2048 * 8192 * 48 AS BIGINT) AS t)",
    "batch_padding": f"""WITH {_LEN}, r AS (SELECT tokens, (row_number() OVER (ORDER BY sha256('3:' || doc_id), doc_id) - 1) // 16 AS batch FROM l),
        b AS (SELECT max(tokens) AS most, count(*) AS n, sum(tokens) AS real FROM r GROUP BY batch) SELECT CAST(sum(real) AS BIGINT) AS real_tokens, CAST(sum(CAST(ceil(most / 8.0) AS BIGINT) * 8 * n) AS BIGINT) AS padded_tokens, count(*) AS batches FROM b""",
    "completion_mask": """SELECT conv_id, turn, array_to_string(list_resize(list_transform(range(turn + 1), lambda i: -100) || [7, 8], CAST(ceil((turn + 3) / 4.0) AS BIGINT) * 4, -100), ' ') AS labels FROM conversations""",
    "token_shares": f"WITH {_LEN} SELECT lang, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS prompt_tokens, CAST(sum(words) AS BIGINT) AS completion_tokens, CAST(sum(CAST(ceil((tokens + words) / 64.0) AS BIGINT) * 64) AS BIGINT) AS padded_tokens FROM l GROUP BY 1",
    "token_estimates": f"WITH {_LEN} SELECT doc_id, tokens FROM l",
    "length_filter": f"WITH {_LEN} SELECT CASE WHEN tokens <= 1000 THEN 'fits' ELSE 'dropped' END AS part, lang, count(*) AS n, max(tokens) AS longest FROM l GROUP BY 1, 2",
    "epoch_stream": """WITH e AS (SELECT unnest([0, 1, 2]) AS epoch), n AS (SELECT count(*) AS n FROM benchmark),
        p AS (SELECT epoch, item_id, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY sha256('5:' || epoch || ':' || item_id), item_id) - 1 AS pos FROM benchmark, e, n) SELECT pos // 16 AS step, pos % 16 AS slot, epoch, item_id FROM p""",
    "lr_schedule": "SELECT s AS step, round(1e6 * CASE WHEN s < 50 THEN 2e-4 * (s + 1) / 50.0 ELSE 2e-4 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (s - 50) / 950.0)))) END, 6) AS lr FROM (SELECT unnest(range(1000)) AS s)",
    "early_stop": f"""WITH {_EV}, a AS (SELECT *, max(score) OVER w AS best, max(score) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM v WINDOW w AS (PARTITION BY run ORDER BY step)),
        i AS (SELECT *, prior IS NULL OR score > prior AS improved FROM a), s AS (SELECT *, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS g FROM i),
        b AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, g ORDER BY step) - 1 AS INT) AS bad FROM s), f AS (SELECT run, min(step) AS first FROM b WHERE bad >= 8 GROUP BY 1)
        SELECT run, step, score, improved, best, bad, bad >= 8 AS stop FROM b LEFT JOIN f USING (run) WHERE first IS NULL OR step <= first""",
    "log_windows": f"WITH {_EV} SELECT run, CAST(ceil(step / 500.0) AS BIGINT) AS \"window\", CAST(sum(step % 9 + 1) AS BIGINT) AS tokens, round(sum(score * (step % 9 + 1)) / sum(step % 9 + 1), 6) AS loss FROM v GROUP BY 1, 2",
    "run_summaries": f"WITH {_EV} SELECT run, min_by(score, step) AS first_loss, max_by(score, step) AS last_loss, median(step % 17) AS median_s, max(step % 17) AS max_s, count(*) AS steps FROM v GROUP BY 1",
    "checkpoints_dropped": f"WITH {_EV} SELECT run, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM v) WHERE k > 5",
    "cost_rollup": """WITH u AS (SELECT event_type, (user_id % 20) / 4.0 / 8 AS s, CASE event_id % 3 WHEN 0 THEN (event_id % 100 * 10 * 2.0 + user_id % 50 * 8.0) / 1e6 WHEN 1 THEN (event_id % 7) / 1000.0 ELSE (user_id % 20) / 4.0 / 8 * 3.6 / 3600 END AS d FROM events)
        SELECT event_type, count(*) AS n, round(CAST(sum(s) AS DOUBLE), 6) AS seconds, round(CAST(sum(d) AS DOUBLE), 6) AS dollars, round(1000 * CAST(sum(d) AS DOUBLE) / count(*), 6) AS dollars_per_1k FROM u GROUP BY 1""",
    "prompt_render": f"{O.scoped()} SELECT game_id || '#' || play_id AS key, 'posteam: ' || posteam || chr(10) || 'los: ' || yrdln || chr(10) || 'desc: ' || descr AS prompt FROM sc",
    "fewshot_messages": """SELECT conv_id, 'system:Read one play.|' || string_agg('user:' || coalesce(role, '') || '|assistant:' || coalesce(text, ''), '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1""",
    "dataset_manifest": f"""{O.labels()}, j AS (SELECT bucket, '{{"game_id":"' || game_id || '","play_id":' || play_id || ',"label":"' || replace(label, '"', '\\"') || '"}}' AS line FROM labels)
        SELECT bucket, count(*) AS n_rows, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, bit_xor(CAST('0x' || substr(md5(line), 1, 15) AS BIGINT)) AS folded FROM j GROUP BY 1""",
    "contract_violations": f"""WITH {O.plays_sql()}, p AS (SELECT CASE WHEN descr IS NULL THEN 'descr is missing' WHEN play_type IS NULL THEN 'play_type is missing' WHEN play_type NOT IN ('pass', 'run', 'no_play') THEN 'play_type is outside its vocabulary' END AS problem FROM plays)
        SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
    "hash_sample": "SELECT doc_id, lang FROM documents ORDER BY sha256('9:' || doc_id), doc_id LIMIT 100",
}
