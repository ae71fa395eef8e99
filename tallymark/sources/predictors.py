"""The seam for models: a predictor is a function over batches with a configuration that is hashed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.provenance import config_hash
from tallymark.plans.shipping import ship


class Predictor(Protocol):
    name: str

    def config(self) -> dict: ...

    def predict(self, texts: list[str | None], teams: list[str | None]) -> list[str | None]: ...


class RuleParser:
    """The rule parser as a predictor: it answers with label text."""

    name = "rules"

    def config(self) -> dict:
        return {"name": self.name, "version": 1}

    def predict(self, texts: list[str | None], teams: list[str | None]) -> list[str | None]:
        from tallymark.functions.labels_json import label_text
        from tallymark.functions.parser import read

        rows = [read(t, p) for t, p in zip(texts, teams, strict=True)]
        return [label_text({"nullified": n, "credits": [{"player": p, "stat": s, "value": v} for p, s, v in c]}) for n, c in rows]


def predict(plays: DataFrame, predictor: Predictor, clock: Callable[[], float] | None = None) -> DataFrame:
    """(game_id, play_id, config_hash, raw, latency_s, batch_size). Batches are Arrow batches; a batch's time is each row's latency.

    Without a clock, latency is null, so that the result is the same each time.
    """
    ship(plays.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            began = clock() if clock else None
            raw = predictor.predict(batch["descr"].tolist(), batch["posteam"].tolist())
            took = clock() - began if clock else None
            yield pd.DataFrame({"game_id": batch["game_id"], "play_id": batch["play_id"], "raw": raw, "latency_s": pd.Series([took] * len(raw), dtype="float64"), "batch_size": len(raw)})

    out = plays.select("game_id", "play_id", "descr", "posteam").mapInPandas(run, "game_id string, play_id long, raw string, latency_s double, batch_size int")
    return out.withColumn("config_hash", F.lit(config_hash(predictor.config())))
