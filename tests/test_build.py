"""The dataset build and the command line on the smallest tables."""

import json

from tallymark import __main__ as cli
from tallymark.plans import build

DATA = "/root/testdata/sf0.001"


def test_build_twice_gives_the_same_bytes(spark, tmp_path):
    manifests = [build.build(spark, DATA, str(tmp_path / n), core=40, least=3, subset=50).orderBy("part", "bucket").collect() for n in "ab"]
    assert manifests[0] == manifests[1]
    for part in ("train", "val", "test", "train_subset", "eval_lite"):
        one, two = (next((tmp_path / n / part).glob("part-*")).read_text() for n in "ab")
        assert one == two
        rows = [json.loads(x) for x in one.splitlines()]
        assert rows and [*rows[0]][:9] == build.RECORD
        keys = [(r["season"], r["game_id"], r["play_id"]) for r in rows]
        assert keys == sorted(keys)
        assert sum(m["n_rows"] for m in manifests[0] if m["part"] == part) == len(rows)
    subset = next((tmp_path / "a" / "train_subset").glob("part-*")).read_text().splitlines()
    assert len(subset) == 50


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["query", "split_counts", "--data", DATA, "--out", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    assert cli.main(["crosscheck", "--data", DATA]) == 0
    assert "abs_diff" in capsys.readouterr().out
    assert cli.main(["gate", "--data", DATA, "--min-valid", "0.999"]) == 2
