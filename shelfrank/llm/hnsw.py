"""Approximate nearest neighbours by inner product: one small-world graph per shard.

Equal vectors collapse to one node. Nodes are dealt by hash into shards of bounded size; each
shard becomes a hierarchical navigable small-world graph in one task. The index is a table of
flat arrays: vectors, neighbours per layer (a fixed number of slots per node, -1 if empty)
and the members of the layers. Each batch of queries reads shard after shard from the stored
table; the nearest nodes are merged by a running top-k.

Inner product is made a metric by one more component that gives all vectors of a shard the
same length. A ring over all nodes in the lowest layer keeps every node reachable.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of
different lengths are separate collections. Of equal vectors those with the smallest ids
come first; rows with equal ids are one candidate. Scores are double sums over the original
components in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.common import saved, width

SHARD_ROWS = 8192
LINKS = 16
BUILD_WIDTH, SEARCH_WIDTH = 100, 120
# Walks that go side by side, nodes that each takes at once, and nodes inserted at once.
QUERY_BLOCK, STEP, BATCH = 512, 8, 256
TOP = 20

SHARD = (
    "dim int, shard int, n int, keys binary, vectors binary, levels binary, low binary, "
    "upper binary, entry int"
)


class Graph:
    """Layers over ``vectors`` (rows of equal length), lowest layer with twice the links.

    Walks of many queries go side by side, ``STEP`` nodes of each at a time, and nodes are
    inserted in batches: those of a batch meet the graph before it and each other.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, low=None, upper=None, entry=-1):
        self.vectors, self.levels, self.entry = vectors, levels, entry
        n, top = len(vectors), int(levels.max()) if len(vectors) else 0
        self.low = np.full((n, 2 * LINKS + 1), -1, np.int32) if low is None else low
        # Slot 0 of the lowest layer is the ring.
        self.upper = np.full((top, n, LINKS), -1, np.int32) if upper is None else upper

    def links(self, layer: int) -> np.ndarray:
        return self.low if layer == 0 else self.upper[layer - 1]

    def near(self, q: np.ndarray, start: np.ndarray, breadth: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``q`` the ``breadth`` nodes closest to it that a best-first walk meets.

        ``start``: the walks' first nodes, -1 where a row has fewer. Distances and nodes, the
        closest first; missing ones are infinite and -1.
        """
        links, vectors, n = self.links(layer), self.vectors, len(self.vectors)
        # Which nodes a walk has met; the numbers tell apart nodes met twice in one step.
        met = np.full(len(q) * n, -1, np.int32)
        dist = np.full((len(q), breadth), np.inf, np.float32)
        node = np.full((len(q), breadth), -1, np.int32)
        done = np.ones((len(q), breadth), bool)
        row, at = np.nonzero(start >= 0)
        todo, found = row, start[row, at]
        while True:
            key = todo * n + found
            new = met[key] < 0
            key, todo, found = key[new], todo[new], found[new]
            met[key] = np.arange(len(key))
            once = met[key] == np.arange(len(key))
            todo, found = todo[once], found[once]
            apart = vectors[found] - q[todo]
            d = np.einsum("ij,ij->i", apart, apart)
            better = d < dist.max(axis=1)[todo]
            todo, found, d = todo[better], found[better], d[better]
            if len(todo):
                # ``todo`` is in order: a place for each newcomer beside its walk's nodes.
                first = np.flatnonzero(np.diff(todo, prepend=-1))
                walks, sizes = todo[first], np.diff(np.append(first, len(todo)))
                row = np.repeat(np.arange(len(walks)), sizes)
                place = breadth + np.arange(len(todo)) - np.repeat(first, sizes)
                shape = (len(walks), breadth + int(sizes.max()))
                all_d, all_n = np.full(shape, np.inf, np.float32), np.full(shape, -1, np.int32)
                all_o = np.ones(shape, bool)
                all_d[:, :breadth], all_n[:, :breadth], all_o[:, :breadth] = dist[walks], node[walks], done[walks]
                all_d[row, place], all_n[row, place], all_o[row, place] = d, found, False
                best = np.argpartition(all_d, breadth - 1, axis=1)[:, :breadth]
                dist[walks], node[walks], done[walks] = (
                    np.take_along_axis(x, best, 1) for x in (all_d, all_n, all_o)
                )
            walks = np.flatnonzero(~done.all(axis=1))
            if not len(walks):
                break
            open_d = np.where(done[walks], np.inf, dist[walks])
            step = min(STEP, breadth)
            pick = np.argpartition(open_d, step - 1, axis=1)[:, :step]
            row, at = np.nonzero(np.take_along_axis(open_d, pick, 1) < np.inf)
            at = pick[row, at]
            done[walks[row], at] = True
            around = links[node[walks[row], at]]
            row, at = np.nonzero(around >= 0), walks[row]
            todo, found = at[row[0]], around[row].astype(np.int64)
        order = np.lexsort((node, dist), axis=1)
        return np.take_along_axis(dist, order, 1), np.take_along_axis(node, order, 1)

    def spread(self, dist: np.ndarray, nodes: np.ndarray, limit: int) -> np.ndarray:
        """Per row, of nodes by distance those closer to the base than to any node taken before.

        Rows are filled up to ``limit`` with the closest others, then with -1.
        """
        v = self.vectors[nodes]
        square = np.einsum("ijk,ijk->ij", v, v)
        between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        taken = np.zeros(nodes.shape, bool)
        for k in range(nodes.shape[1]):
            hidden = (taken[:, :k] & (between[:, k, :k] < dist[:, k, None])).any(axis=1)
            taken[:, k] = (nodes[:, k] >= 0) & ~hidden & (taken.sum(axis=1) < limit)
        order = np.argsort(np.where(nodes < 0, 2, ~taken), axis=1, kind="stable")[:, :limit]
        return np.take_along_axis(nodes, order, 1)

    def connect(self, new: np.ndarray, dist: np.ndarray, nodes: np.ndarray, layer: int) -> None:
        """Links of inserted nodes to ``nodes`` by distance, and back."""
        links = self.links(layer)
        skip = 1 if layer == 0 else 0
        others = self.spread(dist, nodes, LINKS)
        links[new, skip : skip + others.shape[1]] = others
        row, at = np.nonzero(others >= 0)
        base, added = others[row, at], new[row]
        order = np.argsort(base, kind="stable")
        base, added = base[order], added[order]
        first = np.flatnonzero(np.diff(base, prepend=-1))
        turn = np.arange(len(base)) - np.repeat(first, np.diff(np.append(first, len(base))))
        for t in range(int(turn.max(initial=-1)) + 1):  # one new link of each node at a time
            b, a = base[turn == t], added[turn == t]
            known = (links[b, skip:] == a[:, None]).any(axis=1)
            b, a = b[~known], a[~known]
            free = links[b, skip:] < 0
            some = free.any(axis=1)
            links[b[some], skip + free[some].argmax(axis=1)] = a[some]
            b, a = b[~some], a[~some]
            if not len(b):
                continue
            around = np.hstack([links[b, skip:], a[:, None]])
            apart = self.vectors[around] - self.vectors[b][:, None]
            d = np.einsum("ijk,ijk->ij", apart, apart)
            order = np.argsort(d, axis=1, kind="stable")
            d, around = np.take_along_axis(d, order, 1), np.take_along_axis(around, order, 1)
            links[b, skip:] = self.spread(d, around, around.shape[1] - 1)

    def insert(self, new: np.ndarray) -> None:
        """Nodes none of which is higher than the entry."""
        q, level, high = self.vectors[new], self.levels[new], int(self.levels[self.entry])
        start = np.full((len(new), BUILD_WIDTH), -1, np.int64)
        start[:, 0] = self.entry
        apart = q[:, None] - q[None]
        mates = np.einsum("ijk,ijk->ij", apart, apart)
        np.fill_diagonal(mates, np.inf)
        for layer in range(high, -1, -1):
            pass_by, stay = np.flatnonzero(level < layer), np.flatnonzero(level >= layer)
            if len(pass_by):
                start[pass_by, 0] = self.near(q[pass_by], start[pass_by], 1, layer)[1][:, 0]
            if len(stay):
                dist, nodes = self.near(q[stay], start[stay], BUILD_WIDTH, layer)
                start[stay] = nodes
                dist = np.hstack([dist, mates[np.ix_(stay, stay)]])
                nodes = np.hstack([nodes, np.broadcast_to(new[stay], (len(stay), len(stay)))])
                nodes = np.where(np.isfinite(dist), nodes, -1)
                order = np.argsort(dist, axis=1, kind="stable")[:, :BUILD_WIDTH]
                self.connect(
                    new[stay], np.take_along_axis(dist, order, 1), np.take_along_axis(nodes, order, 1), layer
                )

    def build(self) -> Graph:
        n, i = len(self.vectors), 0
        while i < n:
            # Batches stay small beside the graph they meet; a higher node comes alone.
            if i == 0:
                self.entry = i = 0
                i += 1
                continue
            end = min(n, i + max(1, min(BATCH, i // 4)))
            high = int(self.levels[self.entry])
            above = np.flatnonzero(self.levels[i:end] > high)
            if len(above):
                end = max(i + 1, i + int(above[0]))
            self.insert(np.arange(i, end))
            if self.levels[end - 1] > high:
                self.entry = end - 1
            i = end
        self.low[:, 0] = (np.arange(n) + 1) % n
        return self

    def search_all(self, q: np.ndarray, breadth: int) -> np.ndarray:
        """Per row of ``q`` up to ``breadth`` close nodes, the closest first, then -1."""
        start = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(int(self.levels[self.entry]), 0, -1):
            start = self.near(q, start, 1, layer)[1]
        return self.near(q, start, breadth, 0)[1]

    def search(self, q: np.ndarray, breadth: int) -> list[int]:
        found = self.search_all(q[None], breadth)[0]
        return found[found >= 0].tolist()


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all rows are as long as the longest."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    more = np.sqrt(np.maximum(square.max() - square, 0))
    return np.hstack([vectors, more[:, None]]).astype(np.float32)


def levels_of(vectors: np.ndarray) -> np.ndarray:
    """Exponentially thinning layers, drawn with a fixed seed."""
    draw = np.random.default_rng(len(vectors)).random(len(vectors))
    return np.minimum(-np.log(1 - draw) / np.log(LINKS), 8).astype(np.int8)


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, dim, key, vec`` of vectors that take part; equal vectors have equal keys."""
    v = F.col(vector).cast("array<double>")
    v = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    good = (
        F.col(vector).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return (
        rows.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), v.alias("vec"), good.alias("good"))
        .where("good")
        .select("id", F.size("vec").alias("dim"), F.xxhash64("vec").alias("key"), "vec")
    )


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index table of ``dim, key, vec`` (distinct vectors), one row per shard."""
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("total"))
    count = F.ceil(F.col("total") / shard_rows).cast("int")
    dealt = nodes.join(F.broadcast(sizes), "dim").withColumn(
        "shard", F.pmod(F.xxhash64("key"), count).cast("int")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        vectors = np.stack(pdf.vec.to_numpy())
        graph = Graph(lifted(vectors), levels_of(vectors)).build()
        return pd.DataFrame(
            {
                "dim": [int(pdf.dim.iloc[0])],
                "shard": [int(pdf.shard.iloc[0])],
                "n": [len(pdf)],
                "keys": [pdf.key.to_numpy(np.int64).tobytes()],
                "vectors": [vectors.astype(np.float64).tobytes()],
                "levels": [graph.levels.tobytes()],
                "low": [graph.low.tobytes()],
                "upper": [graph.upper.tobytes()],
                "entry": [graph.entry],
            }
        )

    spread = dealt.repartition(4 * width(nodes.sparkSession), "dim", "shard")
    return saved(spread.groupBy("dim", "shard").applyInPandas(run, SHARD), "graphs")


def stored_graph(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    n = row["n"]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
    graph = Graph(
        lifted(vectors),
        np.frombuffer(row["levels"], np.int8),
        np.frombuffer(row["low"], np.int32).reshape(n, -1),
        np.frombuffer(row["upper"], np.int32).reshape(-1, n, LINKS),
        row["entry"],
    )
    return graph, vectors, np.frombuffer(row["keys"], np.int64)


def _graphs(files: list[str]) -> Iterator[dict]:
    """The shards stored in ``files``, one at a time."""
    for file in files:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                yield from batch.to_pylist()


def _hits(files: list[str], k: int, breadth: int):
    """For batches of queries: the ``k`` nearest nodes of each, over all shards in ``files``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked in batches:
            groups = [(int(dim), part.key.to_numpy(np.int64), np.stack(part.vec)) for dim, part in asked.groupby("dim")]
            best = {dim: (np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)) for dim, q, _ in groups}
            for row in _graphs(files):
                graph = None
                for dim, _, vecs in groups:
                    if dim != row["dim"]:
                        continue
                    graph, vectors, keys = graph or stored_graph(row)
                    for start in range(0, len(vecs), QUERY_BLOCK):
                        block = slice(start, start + QUERY_BLOCK)
                        vec = vecs[block]
                        q = np.hstack([vec, np.zeros((len(vec), 1))]).astype(np.float32)
                        at = graph.search_all(q, breadth)
                        score = np.cumsum(vectors[at] * vec[:, None], axis=2)[:, :, -1]
                        score = np.hstack([best[dim][0][block], np.where(at >= 0, score, -np.inf)])
                        key = np.hstack([best[dim][1][block], keys[at]])
                        order = np.lexsort((key, -score), axis=1)[:, :k]
                        for held, found in zip(best[dim], (score, key), strict=True):
                            held[block] = np.take_along_axis(found, order, 1)
            for dim, query, _ in groups:
                row, at = np.nonzero(best[dim][0] > -np.inf)
                columns = {"query": query[row], "key": best[dim][1][row, at], "score": best[dim][0][row, at]}
                yield pd.DataFrame({"dim": np.full(len(row), dim, np.int32), **columns})

    return run


def shard_hits(index: DataFrame, queries: DataFrame, k: int, breadth: int) -> DataFrame:
    """``dim, query, key, score``: per query vector the ``k`` nearest nodes of all shards.

    ``index`` must be stored. A task holds a batch of queries and reads one shard after the
    other, so neither graphs nor queries are copied for each other.
    """
    # By an expression of its own: an exchange by key alone may be one that is merged by bytes.
    deal = F.xxhash64("key", F.lit(1))
    dealt = queries.select("dim", "key", "vec").repartition(width(index.sparkSession), deal)
    schema = "dim int, query bigint, key bigint, score double"
    return dealt.mapInPandas(_hits(sorted(index.inputFiles()), k, breadth), schema)


def nearest(
    rows: DataFrame,
    is_query,
    k: int = TOP,
    id_col: str = "vec_id",
    vector: str = "embedding",
    breadth: int = SEARCH_WIDTH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each query row.

    ``is_query`` is a column over ``id``. Ties go to smaller ids.
    """
    every = saved(usable(rows, id_col, vector), "vectors")
    # Of equal vectors k + 1 ids are enough: the query's own and k others.
    turn = Window.partitionBy("dim", "key").orderBy("id")
    ids = every.select("dim", "key", "id").distinct()
    members = (
        ids.withColumn("turn", F.row_number().over(turn))
        .where(F.col("turn") <= k + 1)
        .groupBy("dim", "key")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    nodes = every.groupBy("dim", "key").agg(F.any_value("vec").alias("vec"))
    index = build_index(nodes)
    asked = ids.where(is_query)
    vectors = every.where(is_query).groupBy("dim", "key").agg(F.any_value("vec").alias("vec"))
    hits = saved(shard_hits(index, vectors, k + 1, breadth), "shard-hits")
    best = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "key")
    top = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # Equal scores of different vectors are settled by ids, which only the members know.
    candidates = (
        top.join(members, ["dim", "key"])
        .select("dim", "query", "score", F.explode("ids").alias("vec_id"))
        .groupBy("dim", "query")
        .agg(
            F.slice(
                F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1
            ).alias("found")
        )
    )
    own = asked.join(candidates.withColumnRenamed("query", "key"), ["dim", "key"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "hit")).select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.minus")).alias("score"),
    )
