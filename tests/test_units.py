"""Operators on hand-made rows whose answers are known."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.contracts import split_of
from tallymark.functions import spots, text
from tallymark.operators import labeller, provenance, registry, sampling, serving, training
from tallymark.sources import files
from tallymark.streaming import pools

FUMBLES = [
    ("lost", ("A", "P", "D"), (None, None, None), "A"),
    ("kept", ("A", "P", "P"), (None, None, None), None),
    ("out of the end zone", ("A", "P", None), (None, None, None), "A"),
    ("same player twice", ("A", "P", "P"), (None, None, "D"), "A"),
    ("recoverer fumbles", ("A", "P", "P"), ("B", "P", "D"), "B"),
    ("defender fumbles back", ("A", "D", "P"), (None, None, None), None),
    ("mixed", ("A", "P", "P"), ("B", "P", None), None),
    ("both out of bounds", ("A", "P", None), ("B", "P", None), "B"),
]


def test_charged_fumbler(spark):
    rows = [(name, "P", *a, *b) for name, a, b, _ in FUMBLES]
    cols = "name string, posteam string, fumbled_1_player_name string, fumbled_1_team string, fumble_recovery_1_team string, fumbled_2_player_name string, fumbled_2_team string, fumble_recovery_2_team string"
    got = {r["name"]: r["who"] for r in spark.createDataFrame(rows, cols).select("name", labeller.charged_fumbler().alias("who")).collect()}
    assert got == {name: who for name, _, _, who in FUMBLES}


def test_spots(spark):
    cases = [("PHI 30", 70, "PHI 30"), ("DAL 07", 7, "DAL 7"), ("MID 50", 50, "50"), ("50", 50, "50"), ("30", None, None), ("DAL 51", None, None), ("", None, None), (None, None, None)]
    rows = spark.createDataFrame([(s,) for s, _, _ in cases], "s string")
    got = {r["s"]: (r["y"], r["c"]) for r in rows.select("s", spots.to_yardline("s", F.lit("PHI")).alias("y"), spots.canonical_spot("s").alias("c")).collect()}
    assert got == {s: (y, c) for s, y, c in cases}
    yards = spark.range(101).select("id", spots.to_yardline(spots.from_yardline("id", F.lit("PHI"), F.lit("DAL")), F.lit("PHI")).alias("y"))
    assert all(r["id"] == r["y"] for r in yards.collect())


def test_text(spark):
    rows = spark.createDataFrame([("ran for 7 yards, for a loss of 3 yards, for no gain, for −2 yds",), ("for 12 yards. the play was REVERSED. for no gain",), ("nothing",)], "t string")
    got = rows.select(text.stated_yards("t").alias("v"), text.stated_gain("t").alias("g")).collect()
    assert [list(r["v"]) for r in got] == [[-3, -2, 0, 7], [0, 12], []]
    assert [r["g"] for r in got] == [7, 0, None]
    names = [("D.Smith", "11-D.Smith runs", True), ("D.Smith", "11-D.Smith-Schuster runs", False), ("A.B", "x 1-A.B.", True), ("A.B", "1-AxB", False), ("", "x", False)]
    found = spark.createDataFrame(names, "n string, t string, w boolean").select("w", text.whole_name("n", "t").alias("g")).collect()
    assert all(r["w"] == r["g"] for r in found)
    fences = spark.createDataFrame([("```json\n{}\n```",), (" {} ",), ("a ```x```",)], "t string").select(text.without_fence("t").alias("b")).collect()
    assert [r["b"] for r in fences] == ["{}", "{}", "a ```x```"]


def test_prompts(spark):
    row = spark.createDataFrame([("runs", None, "PHI 30")], "t string, p string, l string")
    full = row.select(text.messages("t", "p", "l", "full", "Read.").alias("m")).first()["m"]
    assert [tuple(m) for m in full] == [("system", "Read."), ("user", "posteam: UNK\ndesc: runs")]
    assert row.select(text.messages("t", "p", "l", "minimal_v2").alias("m")).first()["m"][0]["content"] == "posteam: UNK\nlos: PHI 30\ndesc: runs"
    assert text.style_schema("minimal") == "v1"
    for call in (lambda: text.messages("t", "p", "l", "odd"), lambda: text.messages("t", "p", "l", "minimal", "x"), lambda: text.style_schema("minimal", "v2")):
        with pytest.raises(ValueError):
            call()
    plain = spark.createDataFrame([("(12:05) 22-D.Henry left to KC 32 for 17 yards.",)], "t string").select(text.without_names("t").alias("n")).first()["n"]
    assert plain == " PLAYER  left to  SPOT  for # yards."


def test_splits_refuse_unknown_seasons(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1999,)], "season int").select(split_of(F.col("season"))).collect()


def test_assertions(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x")], "k int, w string")
    with pytest.raises(PySparkException):
        provenance.join_or_fail(a, b, ["k"], F.lit(True)).collect()
    assert provenance.join_or_fail(b, a, ["k"], F.col("w") == F.col("v")).count() == 1
    with pytest.raises(PySparkException):
        provenance.unique_or_fail(a.union(a), ["k"]).collect()
    assert provenance.first_wins(a.union(a), ["k"], ["v"]).count() == 2
    assert [tuple(r) for r in provenance.key_differences(a, b, ["k"]).collect()] == [(2, "left")]


def test_allocations():
    assert sampling.water_fill({"a": 3, "b": 100, "c": 100}, 50) == {"a": 3, "b": 24, "c": 23}
    assert sampling.water_fill({"a": 1, "b": 1}, 50) == {"a": 1, "b": 1}
    given = sampling.proportional({"a": 1, "b": 500, "c": 499}, 100)
    assert sum(given.values()) == 100 and given["a"] == 1
    assert sampling.enriched({"lateral": 5, "td": 40, "normal": 500}, 20, "lateral", "normal") == {"lateral": 5, "td": 15, "normal": 20}


def test_gate(spark):
    cols = "sha string, bucket string, n int, exact_match double, valid_rate double"
    now = spark.createDataFrame([("s", "all", 100, 0.9, 1.0), ("s", "td", 40, 0.8, 1.0), ("s", "rare", 5, 1.0, 1.0)], cols)
    models = spark.createDataFrame(
        [("tie", "s", "all", 100, 0.9, 1.0), ("tie", "s", "td", 40, 0.795, 1.0), ("tie", "s", "rare", 5, 0.0, 1.0), ("worse", "s", "all", 100, 0.95, 1.0), ("worse", "s", "td", 40, 0.78, 1.0),
         ("worse", "s", "rare", 5, 1.0, 1.0), ("lacks", "s", "all", 100, 0.95, 0.5), ("other", "t", "all", 100, 0.95, 1.0), ("other", "t", "td", 40, 0.9, 1.0), ("other", "t", "rare", 5, 1.0, 1.0)],
        "model string, " + cols,
    )
    got = {r["model"]: (r["promote"], r["failed"]) for r in registry.decision(registry.gate(models, now)).collect()}
    assert got == {"tie": (True, ""), "worse": (False, "bucket_regression"), "lacks": (False, "bucket_regression,valid_rate"), "other": (False, "eval_file_match")}
    first = registry.decision(registry.gate(models.where("model = 'other'"), now.limit(0))).first()
    assert first["promote"]


def test_registry(spark):
    log = [("a", 1, "register", "v1"), ("a", 2, "promote", "v1"), ("a", 3, "rollback", None), ("a", 4, "register", "v2"), ("a", 5, "register", "v3"), ("a", 6, "reject", "v3"), ("a", 7, "promote", "v2"), ("a", 8, "reject", "v2"), ("b", 1, "promote", "v9")]
    events = spark.createDataFrame(log, "adapter string, at long, action string, version string")
    got = {(r["adapter"], r["version"]): (r["status"], r["is_current"]) for r in registry.states(events).collect()}
    assert got == {("a", "v1"): ("superseded", False), ("a", "v2"): ("promoted", True), ("a", "v3"): ("rejected", False)}
    back = events.union(spark.createDataFrame([("a", 9, "rollback", None)], events.schema))
    got = {r["version"]: (r["status"], r["is_current"]) for r in registry.states(back).collect()}
    assert got == {"v1": ("promoted", True), "v2": ("rolled_back", False), "v3": ("rejected", False)}


def test_pool():
    p = serving.Pool(2, frozenset({"pin"}))
    assert [p.acquire("pin")[0], p.acquire("a")[0], p.acquire("a")[0]] == ["miss", "miss", "hit"]
    assert not p.can_acquire("b") and p.acquire("b") == ("wait", None)
    p.release("a")
    assert not p.can_acquire("b")
    p.release("a")
    assert p.acquire("b") == ("evict", "a")
    with pytest.raises(ValueError):
        p.release("a")


def _actions(spark):
    rows = [(f"p{i % 3}", i, f"a{i * 7 % 5}", "acquire" if i % 4 else "release") for i in range(120)]
    return spark.createDataFrame(rows, "pool string, seq long, adapter string, action string")


def test_streaming_pool_is_the_batch_pool(spark, tmp_path):
    actions = _actions(spark)
    for k in range(3):
        actions.where(F.col("seq").between(40 * k, 40 * k + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = pools.pool_stream(stream, 3).writeStream.format("memory").queryName("pool_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    want = serving.pool_outcomes(actions, 3)
    assert sorted(map(tuple, spark.table("pool_out").collect())) == sorted(map(tuple, want.collect()))


def test_streaming_resume_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([(i % 4, f"2024-01-01 00:0{i % 6}:00", i % 2 == 0) for i in range(12)], "k int, t string, within boolean").withColumn("t", F.col("t").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    pools.append_to(pools.fresh_only(stream, ["k"], "t", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    q = pools.windowed_goodput(stream, "t", "0 seconds", "2 minutes").writeStream.format("memory").queryName("good").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("good").agg(F.sum("requests"), F.sum("attained")).first()[:] == (12, 6)


def test_files(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"game_id":"g","play_id":1,"config_hash":"c"}\n\n{"game_id":"h","play_id":2,"config_hash":"c"}\n{"game_id":"i","pl')
    schema = T.StructType([T.StructField("game_id", T.StringType()), T.StructField("play_id", T.LongType()), T.StructField("config_hash", T.StringType())])
    assert files.append_log(spark, str(path), schema, "c").count() == 2
    with pytest.raises(PySparkException):
        files.append_log(spark, str(path), schema, "other").collect()
    with pytest.raises(PySparkException):
        files.json_lines(spark, str(path), schema, ["game_id"]).collect()
    assert tuple(files.skipped(spark, str(path), schema, F.col("game_id") == "g").first()) == (1, 1, 1)
    rows = spark.createDataFrame([(2, "é"), (1, "b")], "k long, v string").repartition(4)
    for name in ("a", "b"):
        files.write_json_lines(rows, str(tmp_path / name), ["k", "v"], ["k"])
    texts = [next((tmp_path / n).glob("part-*")).read_text() for n in "ab"]
    assert texts[0] == texts[1] == '{"k":1,"v":"b"}\n{"k":2,"v":"é"}\n'
    files.append(rows, str(tmp_path / "a"), ["k", "v"])
    assert files.json_lines(spark, str(tmp_path / "a"), T.StructType([T.StructField("k", T.LongType())]), ["k"]).count() == 4
    with pytest.raises(ValueError, match="it has k, v"):
        rows.write.parquet(str(tmp_path / "p"))
        files.parquet(spark, str(tmp_path / "p"), ["z"])


def test_hashes(spark, tmp_path):
    assert provenance.config_hash({"b": 1, "a": "é"}) == provenance.config_hash(json.loads('{"a":"é","b":1}'))
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, k int")
    one, two = (provenance.unordered_hash(r, ["g"], F.col("k").cast("string")).orderBy("g").collect() for r in (rows, rows.orderBy(F.desc("k"))))
    assert one == two
    (tmp_path / "f.py").write_text("x")
    assert len(provenance.source_hash(tmp_path)) == 64


def test_training(spark):
    rows = spark.createDataFrame([([1, 2], [3])], "p array<int>, c array<int>")
    labels = training.masked_labels(F.col("p"), F.col("c"))
    assert rows.select(training.padded(labels, training.rounded_up(F.size(labels), 4), -100).alias("l")).first()["l"] == [-100, -100, 3, -100]
    evals = spark.createDataFrame([("r", s, v) for s, v in enumerate([1, 3, 2, 2, 5, 4, 4, 4, 9])], "run string, step int, v int")
    got = training.early_stop(evals, "run", "step", "v", 3).orderBy("step").collect()
    assert [r["bad"] for r in got] == [0, 0, 1, 2, 0, 1, 2, 3] and got[-1]["stop"]


def brute_states(log):
    """Each adapter's events one after the other. log: (adapter, at, action, version)."""
    out = {}
    for adapter in {e[0] for e in log}:
        stack, status = [], {}
        for _, _, action, v in sorted(e for e in log if e[0] == adapter):
            if action == "register" and v not in status:
                status[v] = "registered"
            elif action == "promote" and v in status:
                status |= {stack[-1]: "superseded"} if stack else {}
                status[v] = "promoted"
                stack = [*stack, v]
            elif action == "reject" and status.get(v) == "registered":
                status[v] = "rejected"
            elif action == "rollback" and len(stack) > 1:
                status[stack[-1]] = "rolled_back"
                status[stack[-2]] = "promoted"
                stack = stack[:-1]
        out |= {(adapter, v): (s, bool(stack) and v == stack[-1]) for v, s in status.items()}
    return out


def test_registry_folds_long_logs(spark):
    """A long log and many short ones, out of order, against brute force; no log is gathered."""
    import random

    rng = random.Random(7)
    log = [("long" if k % 2 else f"a{k % 50}", k, rng.choice(["register", "promote", "promote", "reject", "rollback"]), f"v{rng.randint(1, 9):04d}") for k in range(6000)]
    states = registry.states(spark.createDataFrame(rng.sample(log, len(log)), "adapter string, at long, action string, version string").repartition(7))
    assert {(r["adapter"], r["version"]): (r["status"], r["is_current"]) for r in states.collect()} == brute_states(log)
    assert "collect_list" not in states._jdf.queryExecution().toString()


def test_registry_state_reads_all_events(spark, tmp_path):
    """Later events and other users count too."""
    from tallymark.plans import catalog_eval

    events = [(k, k % 60) for k in range(5800, 6400)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    actions = ["register", "register", "promote", "reject", "rollback"]
    log = [(f"a{u}", k, actions[k % 5], f"v{1 + k % 4:04d}") for k, u in events]
    got = {(r["adapter"], r["version"]): (r["status"], r["is_current"]) for r in catalog_eval.registry_state(spark, str(tmp_path)).collect()}
    assert got == brute_states(log)
