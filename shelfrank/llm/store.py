"""Files written by tasks: temporary names first, then a manifest of what counts."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import saved

MANIFEST = "name string, temporary string, bytes bigint, records bigint, sha1 string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class NewFile:
    """A file under a temporary name of this attempt, with its size and digest."""

    def __init__(self, folder: str, name: str):
        self.name = name
        self.temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        self.store, root = opened(folder)
        self.store.create_dir(root, recursive=True)
        self.out = self.store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.bytes = self.records = 0
        self.sha1 = hashlib.sha1()

    def write(self, data: bytes, records: int = 1) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.bytes += len(data)
        self.records += records

    def close(self) -> tuple:
        self.out.close()
        return self.name, self.temporary, self.bytes, self.records, self.sha1.hexdigest()


def manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["name", "temporary", "bytes", "records", "sha1"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
    )


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Gives the files of ``written`` (rows of ``MANIFEST``) their names; the final manifest.

    Files of lost or repeated attempts never get into a manifest, so readers don't see them.
    A repeated move finds the file under its final name.
    """
    spark = written.sparkSession
    pending = saved(written, "pending")

    def move(batches):
        store, root = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                elif store.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is not what was written")
            yield batch

    path = f"{folder}/manifest"
    pending.mapInArrow(move, pending.schema).write.parquet(path)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").drop("temporary")


def one_task_each(files: DataFrame, by: str = "name") -> DataFrame:
    """Manifest rows dealt out evenly, however few bytes they are."""
    n = max(1, min(files.count(), 10_000))
    return files.repartitionById(n, F.pmod(F.xxhash64(by), n).cast("int"))
