"""Near-duplicate documents by SimHash with pigeonhole blocks.

A text has a 64-bit fingerprint: bit i is set if more than half of its shingle hashes have
it. Fingerprints are cut into ``max_distance + 2`` blocks; two that differ in at most
``max_distance`` bits agree on at least two blocks. The join key is such a pair of blocks
(25 bits and more), which keeps candidate groups small, and is verified by Hamming distance.

Copies share a fingerprint and collapse before the join. Within a key, fingerprints are
dealt into tiles, and a tile pair reports a spanning forest of its links instead of all
pairs, so a crowded key needs bounded memory and gives no quadratic output.

Null and empty texts have fingerprint zero. Rows with equal ids keep one row each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import components, row_key, saved, text_blocks, width

BITS = 64
TILE_ROWS = 2048
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def fingerprint(text: bytes, words: int) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(h[:, i], minlength=256) @ _SPREAD for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``id_col, fingerprint`` (bigint with the 64 bits) of every row."""

    def run(batches):
        for rows, texts in text_blocks(batches, [id_col], "text"):
            found = [fingerprint(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa_id), pa.array(found, pa.int64())],
                [id_col, "fingerprint"],
            )

    kind = docs.schema[id_col].dataType
    pa_id = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
    return docs.select(id_col, "text").mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, fingerprint bigint"
    )


def blocks(max_distance: int) -> list[list[tuple[int, int]]]:
    """Per join key its two blocks, each as (shift, bits)."""
    n = max_distance + 2
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(pair) for pair in combinations(parts, 2)]


def forest(a: np.ndarray, b: np.ndarray, same: bool, max_distance: int):
    """Links of a spanning forest of the graph between ``a`` and ``b`` (equal if ``same``)."""
    parent = list(range(len(a) if same else len(a) + len(b)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shift = 0 if same else len(a)
    for i in range(len(a)):
        start = i + 1 if same else 0
        near = np.flatnonzero(np.bitwise_count(b[start:] ^ a[i]) <= max_distance) + start
        for j in near.tolist():
            x, y = top(i), top(j + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield a[i], b[j]


def links(prints: DataFrame, max_distance: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that join all that are within reach.

    ``prints`` has one row per distinct ``fingerprint``.
    """
    spark = prints.sparkSession
    keys = F.array(
        *[
            F.struct(
                F.lit(k).alias("table"),
                *[
                    F.shiftrightunsigned("fingerprint", s).bitwiseAND((1 << n) - 1).alias(name)
                    for name, (s, n) in zip(("left", "right"), pair, strict=True)
                ],
            )
            for k, pair in enumerate(blocks(max_distance))
        ]
    )
    keyed = prints.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.*")
    key = ["table", "left", "right"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile_rows).cast("int")
    dealt = keyed.join(sizes, key).select(
        *key,
        "fingerprint",
        tiles.alias("tiles"),
        F.pmod(F.xxhash64("fingerprint"), tiles).cast("int").alias("tile"),
    )
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = dealt.select(*key, "fingerprint", "tile", F.explode(other).alias("other")).select(
        *key,
        F.least("tile", "other").alias("row"),
        F.greatest("tile", "other").alias("col"),
        F.col("tile").alias("own"),
        "fingerprint",
    )
    group = [*key, "row", "col"]
    small = dealt.repartition(width(spark), *group)

    def run(batches):
        """Rows come sorted by group, so that one group is held at a time."""
        held, current = [], None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            code = np.stack(cols[:5], 1)
            edges = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
            for s, e in zip([0, *edges], [*edges, len(code)], strict=True):
                if e == s:
                    continue
                mark = tuple(code[s])
                if mark != current:
                    if held:
                        yield from flush(current, held)
                    held, current = [], mark
                held.append((cols[5][s:e], cols[6][s:e]))
        if held:
            yield from flush(current, held)

    def flush(mark, held):
        own = np.concatenate([h[0] for h in held])
        values = np.concatenate([h[1] for h in held]).view(np.uint64)
        row, col = mark[3], mark[4]
        first = values[own == row]
        second = first if row == col else values[own == col]
        found = list(forest(first, second, row == col, max_distance))
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return (
        small.sortWithinPartitions(*group)
        .select(*group, "own", "fingerprint")
        .mapInArrow(run, "a bigint, b bigint")
    )


def classes(prints: DataFrame, max_distance: int, id_col: str) -> DataFrame:
    """``fingerprint, component_id`` of all distinct fingerprints of ``id_col, fingerprint``."""
    distinct = saved(
        prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct-fingerprints"
    )
    roots = components(links(distinct, max_distance), "fingerprint-links")
    placed = distinct.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("fingerprint", "component_id")


def near_duplicates(
    docs: DataFrame, words: int = 3, max_distance: int = 3, id_col: str = "doc_id"
) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable."""
    prints = saved(fingerprints(docs, words, id_col), "fingerprints")
    return prints.join(classes(prints, max_distance, id_col), "fingerprint").select(
        id_col, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, words: int = 3, max_distance: int = 3, id_col: str = "doc_id"
) -> DataFrame:
    """One row of ``docs`` per component: of the smallest id, and of its rows any one.

    The survivors' keys are joined back; the join's partitioning serves to drop equal rows.
    """
    keyed = docs.select(
        F.struct("*").alias("row"),
        row_key(docs).alias("key"),
        F.col("text"),
    )
    prints = saved(fingerprints(keyed, words, "key"), "fingerprints")
    ids = docs.select(row_key(docs).alias("key"), F.col(id_col).alias("id"))
    ordered = prints.join(ids.distinct(), "key").select(
        F.struct("id", "key").alias("id"), "fingerprint"
    )
    ordered = saved(ordered, "fingerprint-ids")
    found = classes(ordered, max_distance, "id").select(F.col("component_id.key").alias("key"))
    return (
        keyed.select("row", "key")
        .join(found.distinct(), "key")
        .dropDuplicates(["key"])
        .select("row.*")
    )
