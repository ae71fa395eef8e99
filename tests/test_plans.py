"""Plans that the library's queries should have."""

import re

from tallymark.operators import reconcile, sampling
from tallymark.plans import catalog_plays
from tallymark.plans.ranks import numbered, ranked

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_read_the_columns_of_the_query(spark):
    physical = plan(catalog_plays.timeout_filter(spark, DATA)).split("== Physical Plan ==")[1]
    schema = re.search(r"ReadSchema: struct<([^>]*)>", physical)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"game_id", "play_id", "play_type", "descr"}
    assert "PushedFilters: [IsNotNull(play_type), EqualTo(play_type,no_play)]" in physical
    scope = plan(catalog_plays.scope_filter(spark, DATA)).split("== Physical Plan ==")[1]
    assert "Or(In(play_type, [no_play,pass,run]),EqualTo(two_point_attempt,1.0))" in scope and "IsNotNull(descr)" in scope


def test_expressions_stay_in_the_jvm(spark):
    for query in (catalog_plays.labels_long, catalog_plays.player_game_points, catalog_plays.reconcile_agreement):
        assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoop", plan(query(spark, DATA)).split("== Physical Plan ==")[1])


def test_pivot_takes_no_job_for_its_values(spark):
    credits = spark.createDataFrame([("g", "t", "p", "rec", 1)], "game_id string, team string, player string, stat string, value int")
    assert reconcile.totals(credits).columns[3:] == ["pass_yds", "pass_td", "int", "rush_yds", "rush_td", "rec", "rec_yds", "rec_td", "fumble_lost", "two_pt"]


def test_top_ranks_are_limited_before_the_exchange(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as g")
    physical = plan(ranked(rows, ["g"], ["id"], "r", 5)).split("== Physical Plan ==")[1]
    assert physical.count("WindowGroupLimit") == 2
    assert ranked(rows, ["g"], ["id"], "r", 5).count() == 15


def test_positions_by_blocks(spark):
    rows = spark.range(5000)
    placed = numbered(rows, [sampling.hash_order(1, "id"), "id"], "at")
    assert sorted(r["at"] for r in placed.collect()) == list(range(5000))
    assert [r["id"] for r in placed.orderBy("at").collect()] == [r["id"] for r in rows.orderBy(sampling.hash_order(1, "id"), "id").collect()]
