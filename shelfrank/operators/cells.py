"""Items with vectors in cells around centres, so that a search reads only cells that can count.

Each item lies in the folder of its nearest centre; a cell knows how far its items lie from the
centre at most, and their best quality. For a request ``q`` no item of a cell has a dot product
above ``q . centre + |q| * radius`` (Cauchy-Schwarz), whatever the centres are. A search reads
each request's most promising cells, takes the k-th best score found as a floor, and then reads
those other cells whose bound reaches a floor. Items without a vector have a cell of their own,
with a dot product of 0. The result is exact; how much is skipped depends on how the vectors
cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.operators import semantic as V
from shelfrank.runtime import fits, new_folder, write_parquet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CELLS = 1_024
ROUNDS = 2
FIRST_CELLS = 2
NO_VECTOR = -1
# Bounds and scores are sums in different orders.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """``table`` (folders by ``cell``) and what is known of each cell, in the order of ``ids``."""

    table: DataFrame
    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    quality: np.ndarray

    def bounds(self, asked: V.BlockTopK) -> np.ndarray:
        """The highest score that an item of a cell can have, requests by cells."""
        dot = np.zeros((len(asked.ids), len(self.ids)))
        if (self.ids != NO_VECTOR).any():
            dot = asked.q @ self.centres.T + np.linalg.norm(asked.q, axis=1)[:, None] * self.radius
        # An own item counts as 0, even where its product is negative.
        liked = np.array(sorted({r for rows in asked.own.values() for r in rows}), int)
        dot[liked] = np.maximum(dot[liked], 0.0)
        return asked.ws[:, None] * dot + asked.wq[:, None] * self.quality + SLACK


def nearest_centre(centres: np.ndarray):
    """Function for ``mapInPandas``: adds ``cell`` and ``distance``."""
    half = (centres**2).sum(axis=1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["vector"].notna().to_numpy()
            x = V._matrix(batch["vector"], centres.shape[1])
            cell = np.argmax(x @ centres.T - half, axis=1)
            distance = np.linalg.norm(x - centres[cell], axis=1)
            yield batch.assign(
                cell=np.where(known, cell, NO_VECTOR).astype("int32"), distance=np.where(known, distance, 0.0)
            )

    return run


def build_cells(items: DataFrame, n_cells: int | None = None, rounds: int = ROUNDS) -> Cells:
    """Cells over ``items`` (``semantic.ITEM_COLUMNS``), about the root of their number.

    First centres are the items of smallest hash; each round moves them to the mean of their
    cell. At most ``MAX_CELLS`` vectors are ever on the driver.
    """
    spark = items.sparkSession
    items = items.select(*V.ITEM_COLUMNS)
    given = items.where(F.col("vector").isNotNull())
    n_cells = n_cells or min(MAX_CELLS, max(1, isqrt(given.count())))
    seeds = given.orderBy(F.xxhash64("item_id"), "item_id").limit(n_cells).toPandas()["vector"]
    centres = V._matrix(seeds, V._width(seeds)) if len(seeds) else np.zeros((1, 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    schema += ", cell int, distance double"
    for _ in range(rounds):
        dealt = given.mapInPandas(nearest_centre(centres), schema)
        sums = dealt.select("cell", F.posexplode("vector").alias("at", "x")).groupBy("cell", "at")
        means = sums.agg(F.avg(F.col("x").cast("double")).alias("x")).toPandas()
        centres[means["cell"], means["at"]] = means["x"]
    path = new_folder(spark, "cells")
    items.mapInPandas(nearest_centre(centres), schema).write.partitionBy("cell").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    facts = table.groupBy("cell").agg(F.max("distance").alias("r"), F.max("quality_score").alias("q"))
    facts = facts.orderBy("cell").toPandas()
    ids = facts["cell"].to_numpy(int)
    none = np.zeros((1, centres.shape[1]))
    at = np.concatenate([centres, none])[ids]
    return Cells(table, ids, at, facts["r"].to_numpy(float), facts["q"].fillna(0.0).to_numpy(float))


def search_cells(
    cells: Cells, requests: DataFrame, k: int, by_reviews: bool = False, log: list | None = None
) -> DataFrame:
    """As ``semantic.dense_top_k`` over the items of ``cells``, reading fewer of them.

    ``log`` gets the numbers of (request, cell) pairs: of the first look, of the second, and of
    all. Requests beyond the broadcast limit take the grid over all items.
    """
    requests = requests.select(*V.REQUEST_COLUMNS)
    if not len(cells.ids):
        return requests.sparkSession.createDataFrame([], V.TOP_SCHEMA)
    if not fits(requests, V.BROADCAST_REQUESTS):
        return V.grid_top_k(cells.table.select(*V.ITEM_COLUMNS), requests, k, by_reviews)
    frame = requests.toPandas()
    if not len(frame):
        return requests.sparkSession.createDataFrame([], V.TOP_SCHEMA)
    width = cells.centres.shape[1] if (cells.ids != NO_VECTOR).any() else V._width(frame["vector"])
    frame["vector"] = [v if v is not None else [0.0] * width for v in frame["vector"]]
    bounds = cells.bounds(V.BlockTopK(frame, k, by_reviews))
    shared = requests.sparkSession.sparkContext.broadcast(frame)
    best = np.argsort(-bounds, axis=1)[:, :FIRST_CELLS]
    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, best, True, axis=1)
    near = write_parquet(_scanned(cells, shared, first, k, by_reviews), "near")
    score = F.round(F.col("score"), V.RANK_DIGITS)
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(score)))
    kth = near.select("request_id", place.alias("place"), score.alias("score")).where(F.col("place") == k)
    floors = {r["request_id"]: r["score"] for r in kth.collect()}
    floor = np.array([floors.get(i, -np.inf) for i in frame["request_id"]])
    rest = (bounds >= floor[:, None]) & ~first
    if log is not None:
        log += [int(first.sum()), int(rest.sum()), rest.size]
    found = near
    if rest.any():
        found = near.unionByName(_scanned(cells, shared, rest, k, by_reviews))
    return found.drop("score")


def _scanned(cells: Cells, shared, wanted: np.ndarray, k: int, by_reviews: bool) -> DataFrame:
    """The k best of each task for the wanted (request, cell) pairs; other folders aren't read."""
    of_cell = {int(c): np.flatnonzero(wanted[:, n]) for n, c in enumerate(cells.ids) if wanted[:, n].any()}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = V.BlockTopK(shared.value, k, by_reviews)
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                top.add(part, of_cell[int(cell)])
        yield from top.rows(scores=True)

    table = cells.table.where(F.col("cell").isin(*of_cell)).select(*V.ITEM_COLUMNS, "cell")
    return table.mapInPandas(scan, V.TOP_SCHEMA + ", score double")
