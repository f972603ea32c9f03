"""What a fitted model stores, and what is moved to make it and to score its pairs."""

import os
import re

import pytest
from pyspark.sql import functions as F

from shelfrank.functions.lexicon import SHOP
from shelfrank.operators import ranking as R
from shelfrank.plans import fixtures as D
from shelfrank.runtime import shared_dir


def folders(spark):
    path = re.sub("^file:/*", "/", shared_dir(spark))
    return set(os.listdir(path)) if os.path.isdir(path) else set()


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    before = folders(spark)
    model = R.build_model(D.catalog(spark, sf_dir).where("length(description) < 600"), SHOP)
    return model, {re.sub("^shelfrank_|_[0-9a-f]{12}$", "", x) for x in folders(spark) - before}


def test_a_model_keeps_only_what_is_read_later(fitted):
    model, written = fitted
    assert {"items", "postings", "blocks", "vocab"} <= written
    assert not written & {"counts", "totals", "item_blocks"}
    assert set(model.blocks.rows.columns) == {"part", "block", "best_quality", "term", "cells"}
    assert model.index.vocab.count() > 0


def test_documents_are_dealt_for_one_join(spark, sf_dir):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        plan = D.catalog(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for key in conf:
            spark.conf.unset(key)
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and "documents.parquet" in line)
    above, depth = [], len(plan[at])
    for line in reversed(plan[: at + 1]):
        indent = re.search(r"[A-Za-z*(]", line).start()
        if indent < depth:
            above.append(line)
            depth = indent
    assert sum(" Exchange " in line for line in above) == 1


def test_pairs_scored_where_items_lie_are_those_joined_later(spark, sf_dir, fitted, monkeypatch):
    model, _ = fitted
    requests = D.requests(spark, sf_dir)

    def rows():
        df = R.score_matches(model, requests)
        numbers = [c for c, kind in df.dtypes if kind == "double"]
        return sorted(df.dtypes), df.select(*sorted(df.columns)).withColumns({c: F.round(c, 9) for c in numbers})

    names, joined = rows()
    want = sorted(map(str, joined.collect()))
    monkeypatch.setattr(R, "PROBE_FROM_ROWS", 0)
    moved = []
    monkeypatch.setattr(R, "matched_pairs", lambda *a, **b: moved.append(1))
    also, placed = rows()
    assert names == also and want and sorted(map(str, placed.collect())) == want and not moved
