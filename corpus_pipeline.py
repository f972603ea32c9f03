"""From raw documents to packed training sequences: five stages over a table of documents.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the
columns of documents. ``run`` writes each result as Parquet in the cluster's shared folder
and reads it again as the next one's input. Rows with null or empty texts pass all filters
and are packed as their end ids; of such documents the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm import decontam, line_dedup, packing, simhash, toxicity
from shelfrank.llm.common import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labelled ones scores below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that too many pages of their source have."""
    cleaned = line_dedup.drop_boilerplate(docs, counts=False)
    if "n_chars" not in docs.columns:
        return cleaned
    size = F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", size)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of which stands in the benchmark."""
    return decontam.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences."""
    return packing.packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# SQL can express neither the learnt model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
