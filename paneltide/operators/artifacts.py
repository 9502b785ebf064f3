"""Fitted models in a registry, and scoring that falls back to a rule where no model can be trusted.

A registry is a folder: `trees` and `meta` hold one partition per version, `pointer` one row per
promotion. A version is written before the pointer names it, and a pointer row is never changed, so
a job that dies in between leaves the model in use as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.operators.boosting import TREES, Forest, scored
from paneltide.sources.shared import shared_path

META = "version string, meta string"
POINTER = "n long, version string"


@dataclass(frozen=True)
class Model:
    """A model in use: its version, the features that it was trained on, what else was saved with it, and its trees."""

    version: str
    features: list[str]
    meta: dict
    forest: Forest


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written there
        return None


def save(trees: DataFrame, features: Sequence[str], folder: str, version: str, **meta) -> None:
    """Writes a model's trees (see boosting.TREES; one fold) and what was said about it."""
    spark = trees.sparkSession
    said = spark.createDataFrame([(json.dumps({"features": list(features), **meta}, sort_keys=True),)], "meta string")
    trees.write.mode("overwrite").parquet(f"{folder}/trees/version={version}")
    said.write.mode("overwrite").parquet(f"{folder}/meta/version={version}")


def promote(spark: SparkSession, folder: str, version: str) -> None:
    """From now on this version is in use."""
    told = _rows(spark, f"{folder}/pointer", POINTER)
    n = (told.agg(F.max("n")).first()[0] or 0) + 1 if told is not None else 1
    spark.createDataFrame([(n, version)], POINTER).write.mode("append").parquet(f"{folder}/pointer")


def current(spark: SparkSession, folder: str) -> Model | None:
    """The model that the newest pointer names; None without a pointer, or where the model's files are gone."""
    told = _rows(spark, f"{folder}/pointer", POINTER)
    newest = told.agg(F.max_by("version", "n")).first()[0] if told is not None else None
    if newest is None:
        return None
    trees = _rows(spark, f"{folder}/trees/version={newest}", TREES)
    said = _rows(spark, f"{folder}/meta/version={newest}", "meta string")
    row = said.first() if said is not None else None
    if trees is None or row is None:
        return None
    meta = json.loads(row["meta"])
    # A model's rows are bounded by its settings: rounds times nodes of a tree.
    return Model(newest, meta.pop("features"), meta, Forest(trees.toPandas()))


@dataclass(frozen=True)
class Result:
    """scores: date, ticker, score, fallback_mode, reason."""

    scores: DataFrame
    fallback_mode: bool
    reason: str


def score(
    features: DataFrame, model: Model | None, fallback: Callable[[DataFrame], DataFrame],
    predict: Callable[[DataFrame, Model], DataFrame] | None = None, most_missing: float = 0.5,
) -> Result:
    """The model's scores, or those of the rule where there is no model, a column is missing, or the scores say nothing.

    More columns than the model was trained on do no harm. fallback(features) and predict(features, model)
    give date, ticker and score. Model scores are stored once: they are looked at before they are passed on.
    """

    def rule(reason: str) -> Result:
        said = fallback(features).select("date", "ticker", "score", F.lit(True).alias("fallback_mode"), F.lit(reason).alias("reason"))
        return Result(said, True, reason)

    if model is None:
        return rule("no model artifact promoted")
    if missing := sorted(set(model.features) - set(features.columns)):
        return rule(f"feature schema mismatch (missing: {', '.join(missing)})")
    made = predict(features, model) if predict else scored(features, model.forest)
    path = shared_path(features.sparkSession, "scores")
    made.select("date", "ticker", "score").write.parquet(path)
    stored = features.sparkSession.read.parquet(path)
    usable = F.when(~F.isnan("score"), F.col("score"))
    n, absent, low, high = stored.agg(F.count("*"), F.count_if(usable.isNull()), F.min(usable), F.max(usable)).first()
    if absent > most_missing * n:
        return rule(f"model produced >{most_missing:.0%} NaN scores")
    if low == high:
        return rule("model produced constant scores")
    return Result(stored.select("*", F.lit(False).alias("fallback_mode"), F.lit("model").alias("reason")), False, "model")
