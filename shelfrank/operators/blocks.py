"""Postings in blocks of items, for rankings that skip what can't be listed.

Items are numbered from the best quality down and cut into blocks of ``BLOCK_ITEMS``. A row of
the table is a term in a block: the items that hold it with their weights, and the best quality
of the block, which is close to that of all its items. Terms lie in ``TERM_PARTS`` folders, so a request reads only
the folders of its own terms; a block's terms in one folder are stored as one row of arrays,
which spares sorting terms to write them. Rows are bucketed by block, so sums per block and per
item need no shuffle.

A block's largest weights bound the score of all its items. Where a floor is known, the k-th
best score found so far, blocks under it go before their items are unpacked, and pairs under
it before they meet their items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.operators import grams as G
from shelfrank.operators.index import flat_terms
from shelfrank.runtime import drop_written, parallelism, write_bucketed, write_parquet

# A power of two. Small blocks have tight bounds; rows per term grow as they shrink.
BLOCK_ITEMS = 16
TERM_PARTS = 32
# Sums in another order may differ by this much.
SLACK = 1e-8


@dataclass(frozen=True)
class BlockIndex:
    """``rows``: part, block, best_quality, and arrays of term and cells."""

    rows: DataFrame
    n_postings: int

    @property
    def table(self) -> DataFrame:
        """A row per block and term, with the largest weights of its items."""
        return flat_terms(self.rows).withColumns({"max_content": largest("c"), "max_opinion": largest("o")})

    def parts(self, parts: list[int]) -> DataFrame:
        return flat_terms(self.rows).where(F.col("part").isin(*parts))


def largest(weight: str) -> Column:
    """Of ``cells``, which are few; stored, it would take more room than what it is taken from."""
    return F.array_max(F.transform("cells", lambda x: x[weight]))


def term_part(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % TERM_PARTS).cast("int")


def build_blocks(items: DataFrame, rows: DataFrame, n_postings: int) -> BlockIndex:
    """One shuffle of the items' rows, by block; ``items``: item_id, quality_score."""
    buckets = parallelism(items.sparkSession)
    order = [F.desc("quality_score"), F.col("item_id")]
    ranges = items.select("item_id", "quality_score").repartitionByRange(buckets, *order)
    # Row numbers start anew in each range, at multiples of 2^33.
    numbered = ranges.sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    block = F.shiftright("n", BLOCK_ITEMS.bit_length() - 1).alias("block")
    numbered = write_parquet(numbered.select("item_id", "quality_score", block), "item_blocks")
    placed = rows.join(numbered.hint("shuffle_hash"), "item_id").select("block", "item_id", "quality_score", "term", "w_content", "w_opinion")
    placed = placed.repartition(buckets, "block").sortWithinPartitions("block")
    table = G.block_rows(placed, TERM_PARTS)
    stored = write_bucketed(table, "blocks", "block", buckets, "block", "part")
    drop_written(numbered)
    return BlockIndex(stored, n_postings)


def upper_bound(content: Column, opinion: Column, best_quality: Column) -> Column:
    """The highest score with these sums: coverage can't raise an opinion above itself."""
    return (
        F.col("weight_content") * content
        + F.col("weight_opinion") * F.col("top_factor") * opinion
        + F.col("weight_quality") * best_quality
    )


def block_pairs(
    index: BlockIndex, terms: DataFrame, parts: list[int], shares: DataFrame, floor: DataFrame | None
) -> DataFrame:
    """(request_id, item_id, content_score, opinion_raw) of items sharing a term.

    ``terms`` (request_id, term, qc, qo) must be small enough to broadcast. ``shares`` has the
    weights and ``top_factor`` of each request. With ``floor`` (request_id, floor), pairs that
    can't reach it are left out.
    """
    zero = F.lit(0.0)
    wanted = terms.select("request_id", "term", "qc", "qo", term_part(F.col("term")).alias("part"))
    hits = index.parts(parts).join(F.broadcast(wanted), ["part", "term"])
    most_content = F.coalesce(F.col("qc") * largest("c"), zero)
    most_opinion = F.coalesce(F.col("qo") * largest("o"), zero)
    least = F.coalesce(F.col("floor"), F.lit(-10.0)) - SLACK
    if floor is not None:
        block = Window.partitionBy("request_id", "block")
        bound = upper_bound(
            F.sum(most_content).over(block),
            F.sum(most_opinion).over(block),
            F.max("best_quality").over(block),
        )
        # No more requests than terms, which fit a broadcast.
        limits = shares.join(terms.select("request_id").distinct(), "request_id", "left_semi")
        limits = F.broadcast(limits.join(floor, "request_id", "left"))
        hits = hits.join(limits, "request_id").withColumn("bound", bound).where(F.col("bound") >= least)
    cells = hits.select("request_id", "block", "qc", "qo", "best_quality", F.explode("cells").alias("x"))
    pairs = cells.groupBy("request_id", "block", F.col("x.item_id").alias("item_id")).agg(
        F.sum(F.coalesce(F.col("qc") * F.col("x.c"), zero)).alias("content_score"),
        F.sum(F.coalesce(F.col("qo") * F.col("x.o"), zero)).alias("opinion_raw"),
        F.max("best_quality").alias("best_quality"),
    )
    pairs = pairs.where((F.col("content_score") > 0) | (F.col("opinion_raw") > 0))
    if floor is not None:
        high = upper_bound(F.col("content_score"), F.col("opinion_raw"), F.col("best_quality"))
        pairs = pairs.join(limits, "request_id").where(high >= least)
    return pairs.select("request_id", "item_id", "content_score", "opinion_raw")
