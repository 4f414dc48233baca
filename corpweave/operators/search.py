"""Model search: every setting of a grid over all folds, in the same scans, with a log that is gone on from."""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import DataFrame

from corpweave.operators import networks as N
from corpweave.streaming.log import RecordLog, digest

FOLDS = 5
#: The published grid of logistic models, and of networks with hidden sizes as shares of the input's (256 and 384 of 768).
LOGISTIC = {"c": [0.1, 1.0, 2.0, 3.0, 5.0, 10.0, 30.0, 100.0], "balanced": [False, True]}
NETWORKS = {"layers": [2, 3, 4, 6], "hidden": [1 / 3, 1 / 2], "lr": [3e-4, 1e-3], "weight_decay": [0.0], "dropout": [0.3]}
SCHEMA = "key string, model string, config string, mean double, sd double, per_fold array<double>, per_class array<double>"


def grid(values: dict[str, list]) -> list[dict]:
    return [dict(zip(values, x)) for x in itertools.product(*values.values())]


def searched(df: DataFrame, classes: int, d: int, log: str, config: dict, logistic: list[dict] | None = None, networks: list[dict] | None = None, folds: int = FOLDS, epochs: int = 100, patience: int = 7, together: int = 16, per_step: int = 1, **columns) -> DataFrame:
    """Macro-F1 over the folds of each setting as rows of SCHEMA; ``df`` has the columns that ``networks.packed`` takes.

    Settings go out ``together`` at a time, with all their folds in the same scans, and are logged when they are known.
    What the log at ``log`` has for the same ``config`` (which names the data) is not fitted again."""
    spark = df.sparkSession
    kept = RecordLog(spark, log, SCHEMA, config)
    done = {r[0] for r in kept.records().select("key").collect()}  # a row for each setting
    blocks, n = N.packed(df, classes, **columns)
    logistic, networks = grid(LOGISTIC) if logistic is None else logistic, grid(NETWORKS) if networks is None else networks
    for model, settings in (("logistic", logistic), ("network", networks)):
        todo = [s for s in settings if digest({"model": model} | s) not in done]
        for at in range(0, len(todo), together):
            some = todo[at : at + together]
            if model == "logistic":
                each = [N.Logistic(**s, fold=k) for s in some for k in range(folds)]
                found = N.logistic_scores(blocks, each, N.logistic_models(blocks, each, d, classes), classes)
            else:
                each = [N.Setting(**(s | {"hidden": max(1, round(s["hidden"] * d)) if s["hidden"] < 1 else s["hidden"]}), fold=k) for s in some for k in range(folds)]
                found = N.fold_scores(blocks, [f.network for f in N.trained(blocks, n, each, d, classes, epochs, patience, per_step)], classes)
            rows = []
            for i, s in enumerate(some):
                of = found[i * folds : (i + 1) * folds]
                scores = [N.f1(h) for h in of]
                rows.append((digest({"model": model} | s), model, json.dumps(s, sort_keys=True), float(np.mean(scores)), float(np.std(scores)), scores, np.mean([N.f1(h, False) for h in of], axis=0).tolist()))
            kept.append(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    wanted = [digest({"model": m} | s) for m, settings in (("logistic", logistic), ("network", networks)) for s in settings]
    rows = kept.records()
    return rows.where(rows["key"].isin(wanted))  # as many as the grid has settings
