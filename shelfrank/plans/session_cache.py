"""One fitted model per session and data folder, shared by the registered queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from shelfrank.functions.lexicon import SHOP
from shelfrank.operators import ranking as R
from shelfrank.plans import fixtures as D

_models: dict[tuple[str, str], R.RankModel] = {}


def model(spark: SparkSession, sf_dir: str) -> R.RankModel:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _models:
        _models[key] = R.build_model(D.catalog(spark, sf_dir), SHOP)
    return _models[key]


def semantic_model(spark: SparkSession, sf_dir: str) -> R.RankModel:
    base = model(spark, sf_dir)
    return replace(base, vectors=D.item_vectors(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.catalog(spark, sf_dir)
