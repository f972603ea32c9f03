"""Dense (embedding) scores: blocks of items times blocks of requests.

Every request scores every item here, so pairs are never emitted: each task keeps
only its k best items per request while NumPy multiplies whole Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.operators.index import index_metadata, is_valid
from shelfrank.runtime import fits

# Block functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANK_DIGITS = 9
# Requests whose vectors every Python worker can hold (d = 1024: 32 MB).
BROADCAST_REQUESTS = 4_096
ITEM_BLOCK = 200_000

ITEM_COLUMNS = [
    "item_id", "vector", "quality_score", "has_reviews", "positive_ratio", "release_year",
    "catalog_pos",
]
REQUEST_COLUMNS = ["request_id", "vector", "own_ids", "weight_semantic", "weight_quality"]
TOP_SCHEMA = "request_id string, item_id string, semantic_score double"


def embedding_text(title: Column, genres: Column, tags: Column, description: Column) -> Column:
    """Natural text for an embedding model; blank parts are skipped."""

    def part(col: Column, wrap=lambda c: c) -> Column:
        trimmed = X.strip_ws(F.coalesce(col, F.lit("")))
        return F.when(trimmed != "", wrap(trimmed))

    return F.concat_ws(
        " ",
        X.strip_ws(F.coalesce(title, F.lit(""))),
        part(genres, lambda c: F.concat(F.lit("Genres: "), c, F.lit("."))),
        part(
            tags,
            lambda c: F.concat(F.lit("Tags: "), F.regexp_replace(c, "[|;/]", ","), F.lit(".")),
        ),
        part(description),
    )


def attach_embeddings(
    catalog: DataFrame, vectors: DataFrame | None, stored: DataFrame | None = None, **expected
) -> DataFrame:
    """Catalogue plus ``vector``; NULL where none is stored.

    With ``stored`` metadata the vectors count only if it describes this
    catalogue (provider, version, ids, dimension); otherwise none is attached.
    """
    usable = vectors is not None and (
        stored is None or is_valid(stored, index_metadata(catalog, **expected))
    )
    if not usable:
        return catalog.withColumn("vector", F.lit(None).cast("array<float>"))
    return catalog.join(vectors.select("item_id", "vector"), "item_id", "left")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def reference_vectors(references: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of each request's known liked items, scaled to length 1."""
    dims = (
        references.join(vectors, "item_id")
        .select("request_id", F.posexplode("vector").alias("dim", "x"))
        .groupBy("request_id", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    # One entry per dimension: the list is as long as the vector, never longer.
    cells = dims.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
    )
    return cells.select(
        "request_id",
        F.transform(
            "cells",
            lambda c: F.when(F.col("norm") > 0, c["x"] / F.col("norm")).otherwise(c["x"]),
        ).alias("vector"),
    )


def select_vectors(
    requests: DataFrame, references: DataFrame, vectors: DataFrame, query_vectors: DataFrame | None
) -> DataFrame:
    """The vector a request is compared with: liked items win, the query is then ignored.

    ``requests`` needs ``has_query`` and ``has_references``.
    """
    liked = reference_vectors(references, vectors).select(
        "request_id", F.col("vector").alias("liked_vector")
    )
    out = requests.join(liked, "request_id", "left")
    asked = F.lit(None).cast("array<double>")
    if query_vectors is not None:
        asked_df = query_vectors.select(
            "request_id", F.col("vector").cast("array<double>").alias("asked_vector")
        )
        out = out.join(asked_df, "request_id", "left")
        asked = F.col("asked_vector")
    vector = F.when(F.col("has_references"), F.col("liked_vector")).when(F.col("has_query"), asked)
    return out.withColumn("vector", vector).drop("liked_vector", "asked_vector")


# ---------------------------------------------------------------- block top-k


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        if v is None:
            continue
        if len(v) != dim:
            raise ValueError(f"a vector of {len(v)} numbers among those of {dim}")
        out[i] = v
    return out


def _width(column: pd.Series) -> int:
    return max((len(v) for v in column if v is not None), default=1)


class BlockTopK:
    """The k best items of each request over the batches of one task."""

    def __init__(self, requests: pd.DataFrame, k: int, by_reviews: bool):
        self.ids = requests["request_id"].to_numpy()
        self.q = _matrix(requests["vector"], _width(requests["vector"]))
        self.ws = requests["weight_semantic"].to_numpy(dtype=float)
        self.wq = requests["weight_quality"].to_numpy(dtype=float)
        self.own: dict[str, list[int]] = {}
        for row, ids in enumerate(requests["own_ids"]):
            for item in ids if ids is not None else []:
                self.own.setdefault(item, []).append(row)
        self.k = k
        self.by_reviews = by_reviews
        self.floor = np.full(len(self.ids), -np.inf)
        # Rows kept: request, then the ranking keys (ascending), the product, the item.
        self.keys = np.zeros((0, 5 + by_reviews))
        self.sem = np.zeros(0)
        self.items = np.zeros(0, object)

    def add(self, items: pd.DataFrame, rows: np.ndarray | None = None) -> None:
        """Scores items for all requests, or for those in ``rows``."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        if items.empty or not len(rows):
            return
        sem = self.q[rows] @ _matrix(items["vector"], self.q.shape[1]).T
        place = {r: i for i, r in enumerate(rows.tolist())}
        for col, item in enumerate(items["item_id"]):
            for row in self.own.get(item, ()):
                if row in place:
                    sem[place[row], col] = 0.0
        quality = items["quality_score"].to_numpy(dtype=float)
        total = np.round(self.ws[rows, None] * sem + self.wq[rows, None] * quality, RANK_DIGITS)
        least = self.floor[rows]
        if total.shape[1] > self.k:
            kth = total.shape[1] - self.k
            least = np.maximum(least, np.partition(total, kth, axis=1)[:, kth])
        at, col = np.nonzero(total >= least[:, None])
        ties = [
            -items["positive_ratio"].to_numpy(dtype=float)[col],
            -items["release_year"].to_numpy(dtype=float)[col],
            items["catalog_pos"].to_numpy(dtype=float)[col],
        ]
        if self.by_reviews:
            ties.insert(0, -items["has_reviews"].to_numpy(dtype=float)[col])
        new = np.column_stack([rows[at], -total[at, col], *ties])
        self.keys = np.concatenate([self.keys, new])
        self.sem = np.concatenate([self.sem, sem[at, col]])
        self.items = np.concatenate([self.items, items["item_id"].to_numpy(object)[col]])
        order = np.lexsort(self.keys.T[::-1])
        request = self.keys[order, 0].astype(int)
        rank = np.arange(len(order)) - np.searchsorted(request, request)
        kept = order[rank < self.k]
        last = self.keys[order[rank == self.k - 1]]
        self.floor[last[:, 0].astype(int)] = -last[:, 1]
        self.keys, self.sem, self.items = self.keys[kept], self.sem[kept], self.items[kept]

    def rows(self, scores: bool = False) -> Iterator[pd.DataFrame]:
        if len(self.items):
            frame = pd.DataFrame(
                {
                    "request_id": self.ids[self.keys[:, 0].astype(int)],
                    "item_id": self.items,
                    "semantic_score": self.sem,
                }
            ).astype({"request_id": object, "item_id": object})
            yield frame.assign(score=-self.keys[:, 1]) if scores else frame


def dense_top_k(
    items: DataFrame, requests: DataFrame, k: int, by_reviews: bool = False
) -> DataFrame:
    """Per request and task the k best items by semantic and quality share.

    A superset of the exact top k per request; the caller ranks once more.
    Few requests travel to every task; many are split with the items into a grid
    of blocks, so that neither side is ever held whole.
    """
    items = items.select(*ITEM_COLUMNS)
    requests = requests.select(*REQUEST_COLUMNS)
    if fits(requests, BROADCAST_REQUESTS):
        spark = items.sparkSession
        shared = spark.sparkContext.broadcast(requests.toPandas())

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = BlockTopK(shared.value, k, by_reviews)
            for batch in batches:
                top.add(batch)
            yield from top.rows()

        return items.mapInPandas(scan, TOP_SCHEMA)
    return grid_top_k(items, requests, k, by_reviews)


def grid_top_k(
    items: DataFrame,
    requests: DataFrame,
    k: int,
    by_reviews: bool = False,
    request_block: int = BROADCAST_REQUESTS,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Blocked product: each grid cell holds one request block and one item block."""
    n_rb = -(-requests.count() // request_block)
    n_ib = -(-items.count() // item_block)
    left = (
        requests.withColumn("rb", F.pmod(F.xxhash64("request_id"), F.lit(max(n_rb, 1))))
        .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(max(n_ib, 1) - 1))))
        .withColumn("ib", F.col("ib").cast("bigint"))
    )
    right = (
        items.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(max(n_ib, 1))))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(max(n_rb, 1) - 1))))
        .withColumn("rb", F.col("rb").cast("bigint"))
    )

    def cell(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or block.empty:
            return pd.DataFrame(
                {"request_id": [], "item_id": [], "semantic_score": []}, dtype=object
            )
        top = BlockTopK(asked, k, by_reviews)
        top.add(block)
        return next(top.rows())

    return (
        left.groupBy("rb", "ib").cogroup(right.groupBy("rb", "ib")).applyInPandas(cell, TOP_SCHEMA)
    )


def plain_items(items: DataFrame) -> DataFrame:
    """``item_id, catalog_pos, vector`` with the columns that a search by vectors alone ignores."""
    return items.select(
        "item_id",
        "vector",
        F.lit(0.0).alias("quality_score"),
        F.lit(False).alias("has_reviews"),
        F.lit(0.0).alias("positive_ratio"),
        F.lit(0).alias("release_year"),
        "catalog_pos",
    )


def semantic_top_k(items: DataFrame, requests: DataFrame, k: int, search=None) -> DataFrame:
    """The k nearest items per request by dot product, not clipped below 0.

    ``items``: item_id, catalog_pos, vector; ``requests``: request_id, vector, own_ids.
    ``search(requests, k)`` may replace the scan of all items, as ``cells.search_cells`` does.
    """
    plain_requests = requests.select(
        "request_id",
        "vector",
        "own_ids",
        F.lit(1.0).alias("weight_semantic"),
        F.lit(0.0).alias("weight_quality"),
    )
    if search is None:
        near = dense_top_k(plain_items(items), plain_requests, k)
    else:
        near = search(plain_requests, k)
    near = near.join(items.select("item_id", "catalog_pos"), "item_id")
    order = Window.partitionBy("request_id").orderBy(
        F.desc(F.round("semantic_score", RANK_DIGITS)), "catalog_pos"
    )
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("request_id", "rank", "item_id", "semantic_score")
    )
