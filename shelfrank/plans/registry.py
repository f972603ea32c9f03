"""Registered queries: name -> Spark callable, and SQL where a value check exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, ids: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        SURVEY_IDS[name] = ids
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    from shelfrank.plans import (  # noqa: F401
        q_catalog,
        q_chat,
        q_columns,
        q_explain,
        q_index,
        q_quality,
        q_ranking,
        q_scoring,
    )
