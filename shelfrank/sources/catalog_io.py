"""Catalogue and training-row files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfrank.operators.etl import check_columns
from shelfrank.sources import versions

INSTRUCTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("instruction", "input", "output")]
)
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def _reader(spark: SparkSession, fmt: str, multiline: bool):
    if fmt != "csv":
        return spark.read
    return spark.read.options(**CSV_OPTIONS, multiLine=multiline)


def load_catalog(
    spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = True
) -> DataFrame:
    """Read a catalogue (CSV with header, or parquet); fails early and by name.

    A catalogue written by ``write_catalog`` is read from its current version. Columns arrive
    as written; ``validate_contract`` gives them their types. A CSV file whose texts hold line
    ends is read by one task; without such texts say ``multiline=False``, and large files are
    split.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    at = versions.current(spark, path) or path
    fs, target = versions.hadoop_path(spark, at)
    if not fs.exists(target):
        raise FileNotFoundError(f"no catalogue at {path}")
    if fs.getContentSummary(target).getLength() <= 1:
        raise ValueError(f"empty catalogue at {path}")
    df = _reader(spark, fmt, multiline).format(fmt).load(at)
    check_columns(df)
    return df


def write_catalog(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the catalogue at ``path``, a folder; safe when ``df`` reads from it.

    Rows go to a new version below ``path``, the pointer flips to it, and only then old rows
    are deleted: all versions but the one before, which readers may still follow. A job lost
    in between leaves the old catalogue or the new one. A folder without versions takes the
    pointer the same way; a single file can't, and is refused.
    """
    spark = df.sparkSession
    fs, target = versions.hadoop_path(spark, path)
    if fs.exists(target) and not fs.getFileStatus(target).isDirectory():
        raise ValueError(f"{path} is a single file: give a folder")
    first = fs.exists(target) and versions.current(spark, path) is None
    version = versions.new_version(path)
    writer = df.write.options(**CSV_OPTIONS) if fmt == "csv" else df.write
    writer.format(fmt).save(version)
    versions.publish(spark, version)
    versions.drop_old(spark, path, others=first)


def read_table(
    spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet", multiline: bool = True
) -> DataFrame:
    """A raw source table given by the caller, reduced to the columns used."""
    df = _reader(spark, fmt, multiline).format(fmt).load(path)
    check_columns(df, columns)
    return df.select(*columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8, in a new folder."""
    df.write.option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = INSTRUCTION_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
