"""Session-level helpers: shared folder, size checks, bucketed tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Narrow rows (a few ids and numbers) that every executor can hold: about 100 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the warehouse.

    Without the first, only a local session may go on: elsewhere the warehouse's default is a
    folder of each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shelfrank"
    return root.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-heavy stages; AQE must not merge these by byte size."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than needed."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row check; larger sides keep the shuffled join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def write_bucketed(
    df: DataFrame, label: str, key: str, buckets: int, sort: str, part: str | None = None
) -> DataFrame:
    """Write ``df`` as a parquet table bucketed by ``key`` in the shared folder.

    ``df`` should already be hash-partitioned by ``key`` into ``buckets`` so that
    each task writes one file.
    """
    spark = df.sparkSession
    name = f"shelfrank_{label}_{uuid.uuid4().hex[:12]}"
    writer = df.write.format("parquet")
    if part:
        writer = writer.partitionBy(part)
    (
        writer.bucketBy(buckets, key)
        .sortBy(sort)
        .option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{name}")
        .saveAsTable(name)
    )
    return spark.table(name)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/shelfrank_{label}_{uuid.uuid4().hex[:12]}"


def write_parquet(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Drops what ``write_bucketed`` or ``write_parquet`` has written and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    found = re.search(r"/(shelfrank_[\w-]+)/", files[0]) if files else None
    if found:
        name = found[1]
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
