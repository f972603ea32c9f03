"""What the operators share: the cluster's folder, word arrays, ordered shards, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process only for local sessions without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shelfrank-llm-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """A 96-bit key of a row's whole content: equal rows, and only they, share it.

    Spark's hashes skip nulls, so each column comes with a mark for them; nested columns
    are hashed as JSON, which tells nulls inside them apart and takes maps.
    """
    parts = []
    for field in df.schema.fields:
        value = F.col("`" + field.name.replace("`", "``") + "`")
        parts.append(value.isNull())
        if isinstance(field.dataType, AtomicType):
            parts.append(value)
        else:
            parts.append(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
    return F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.hash(*parts)))


def width(spark: SparkSession) -> int:
    """Partitions of CPU-heavy exchanges, given explicitly so that they aren't merged by bytes."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def text_blocks(
    frames: Iterator, columns: list[str], text: str, max_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows regrouped so that a block's texts have about ``max_bytes`` UTF-8 bytes.

    Null texts count as empty. One longer text is a block of its own, never cut.
    """
    rows: list[tuple] = []
    texts: list[bytes] = []
    size = 0
    for frame in frames:
        lists = [frame.column(c).to_pylist() for c in columns]
        meta = zip(*lists, strict=True) if lists else [()] * frame.num_rows
        for row, value in zip(meta, frame.column(text), strict=True):
            data = value.as_buffer()
            data = b"" if data is None else data.to_pybytes()
            if rows and size + len(data) > max_bytes:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(row)
            texts.append(data)
            size += len(data) + 1
    if rows:
        yield rows, texts


def byte_set(keep) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b for b in range(256) if keep(b)]] = True
    return table


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes], is_word: np.ndarray, lower: bool = True):
    """64-bit hashes of all words and, per text, the index of its first word (n + 1 numbers).

    A word is a run of bytes in ``is_word``; texts are joined by a byte outside it.
    """
    if lower:
        texts = [t.lower() for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        power = np.full(int(lengths.max()), _ODD)
        power[0] = 1
        power = np.multiply.accumulate(power)
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * power[place]
        total = np.add.reduceat(terms, begin) + lengths.astype(np.uint64) * _ODD
    return mix(total), first


def pieces_of(df: DataFrame, key: str, weight: str, target: int, grid: int = 4096):
    """Exact-order shards: boundaries ``[b0, b1, ...]`` of ``key`` with about ``target`` weight.

    A histogram of at most ``grid`` cells between the smallest and the largest key is all
    that reaches the driver; cells heavier than ``target`` are measured again on a finer
    grid. The boundaries depend on the rows alone, not on how Spark has dealt them.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    bounds: list[int] = []
    todo = [(int(low), int(high))]
    cells: list[tuple[int, int, int]] = []
    while todo:
        a, b = todo.pop()
        step = max(1, -(-(b - a + 1) // grid))
        cell = F.floor((F.col(key).cast("decimal(38,0)") - F.lit(a).cast("decimal(38,0)")) / step)
        rows = (
            df.where(F.col(key).between(a, b))
            .groupBy(cell.cast("bigint").alias("cell"))
            .agg(F.sum(weight).alias("w"))
            .collect()
        )
        for r in rows:
            start = a + r.cell * step
            stop = min(start + step - 1, b)
            if r.w > target and step > 1:
                todo.append((start, stop))
            else:
                cells.append((start, stop, r.w))
    held = 0
    for start, _, w in sorted(cells):
        if held and held + w > target:
            bounds.append(start)
            held = 0
        held += w
    return bounds


def shard_of(bounds: list[int]):
    """Column function: how many boundaries lie at or below a bigint key; null comes first."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        valid = key.notna().to_numpy()
        found = np.zeros(len(key), np.int32)
        found[valid] = np.searchsorted(cuts, key[valid].astype("int64"), side="right")
        return pd.Series(found)

    return shard


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder.
    A star step takes a minimum per key with partial sums and a join that Spark can split,
    so a hub needs no task of its own.
    """
    edges = saved(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = saved(large.where("a <> b").distinct(), label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
        small = saved(small.where("a <> b").distinct(), label)
        mark = small.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == before:
            break
        edges, before = small, mark
    roots = small.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
