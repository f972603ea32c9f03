"""Titles found by their text: an equal one, else one that holds the wanted text.

One table has the three characters at each place of every title. A title holds a text if it
holds two of the text's rarest grams at their distance; those few are read and compared. A
text shorter than a gram is the beginning of some gram, and its first title lies among the
first titles of those grams. Postings of hot grams are dealt out over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.runtime import BROADCAST_ROWS, broadcast_if_small, fits, write_parquet

GRAM = 3
# Ends a title's last grams; white space is collapsed, so no title has it.
STOP = "\n"
ROWS_PER_SALT = 500_000


def grams_at(norm: Column) -> Column:
    """``gram, at`` of each place (from 1) of a text that isn't empty."""
    closed = F.concat(norm, F.lit(STOP * (GRAM - 1)))
    return F.transform(
        F.sequence(F.lit(1), F.length(norm)),
        lambda i: F.struct(F.substring(closed, i, F.lit(GRAM)).alias("gram"), i.alias("at")),
    )


def title_grams(titles: DataFrame) -> DataFrame:
    """``gram, at, hit`` of titles ``norm, hit``, stored in the shared folder."""
    rows = titles.where(F.col("norm") != "").select("hit", F.inline(grams_at(F.col("norm"))))
    return write_parquet(rows, "title-grams")


def rarest_two(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """``wanted, a, b``: structs ``n, gram, at`` of a text's rarest grams; ``b`` may be null.

    Texts with a gram that no title has are left out.
    """
    inner = F.slice(grams_at(F.col("wanted")), F.lit(1), F.length("wanted") - GRAM + 1)
    ranked = F.array_sort(F.collect_list(F.struct("n", "gram", "at")))
    return (
        texts.select("wanted", F.inline(inner))
        .join(heads, "gram", "left")
        .groupBy("wanted")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), ranked.alias("g"))
        .where("least > 0")
        .select("wanted", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"))
    )


def starts_of(
    picks: DataFrame, side: str, grams: DataFrame, rows_per_salt: int, broadcast_rows: int
) -> DataFrame:
    """``wanted, hit, start``: where a text would start in the titles that have its gram."""
    asked = picks.where(F.col(side).isNotNull()).select(
        "wanted", F.col(f"{side}.gram").alias("gram"), F.col(f"{side}.at").alias("off"), F.col(f"{side}.n").alias("n")
    )
    if fits(asked, broadcast_rows):
        met = grams.join(F.broadcast(asked), "gram")
    else:
        salts = F.ceil(F.col("n") / rows_per_salt).cast("int")
        # Each hot gram has over rows_per_salt postings, so they are few.
        hot = asked.select("gram", salts.alias("salts")).where("salts > 1").distinct()
        hot = broadcast_if_small(hot)
        count = F.coalesce("salts", F.lit(1))
        left = asked.join(hot, "gram", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1)))
        right = grams.join(hot, "gram", "left").withColumn(
            "salt", F.pmod(F.xxhash64("hit"), count).cast("int")
        )
        met = right.drop("salts").join(left.drop("salts"), ["gram", "salt"])
    start = F.col("at") - F.col("off") + 1
    return met.select("wanted", "hit", start.alias("start")).where("start > 0")


def holding(
    texts: DataFrame,
    titles: DataFrame,
    rows_per_salt: int = ROWS_PER_SALT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``wanted, hit``: for each distinct text the least ``hit`` of the titles that hold it.

    ``titles``: distinct ``norm`` with its ``hit``. Every title holds the empty text.
    """
    grams = title_grams(titles)
    heads = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("hit").alias("hit"))
    size = F.length("wanted")
    begins = F.explode(F.array(*[F.left("gram", F.lit(n)) for n in range(1, GRAM)]))
    short = (
        heads.select(begins.alias("wanted"), "hit")
        .unionByName(titles.select(F.lit("").alias("wanted"), "hit"))
        .groupBy("wanted")
        .agg(F.min("hit").alias("hit"))
        .join(texts.where(size < GRAM), "wanted", "left_semi")
    )
    picks = rarest_two(texts.where(size >= GRAM), heads.drop("hit"))
    picks = write_parquet(picks, "title-picks")
    near = starts_of(picks, "a", grams, rows_per_salt, broadcast_rows)
    other = starts_of(picks, "b", grams, rows_per_salt, broadcast_rows)
    lone = picks.where("b IS NULL").select("wanted")
    both = near.join(other, ["wanted", "hit", "start"], "left_semi").unionByName(
        near.join(broadcast_if_small(lone, broadcast_rows), "wanted", "left_semi")
    )
    long = (
        both.join(titles, "hit")
        .where(F.substring("norm", F.col("start"), F.length("wanted")) == F.col("wanted"))
        .groupBy("wanted")
        .agg(F.min("hit").alias("hit"))
    )
    return short.unionByName(long)


def resolve_titles(candidates: DataFrame, catalog: DataFrame, **options) -> DataFrame:
    """(case_id, item_id): the first candidate title with a hit decides.

    ``candidates``: case_id, candidate_no, title. An exact match beats a substring
    match of the same candidate; ties go to the earliest item. Null counts as empty.
    """
    wanted = candidates.select(
        "case_id", "candidate_no", X.ascii_normalise(F.col("title")).alias("wanted")
    )
    names = catalog.select(
        "item_id", "catalog_pos", X.ascii_normalise(F.col("title")).alias("norm")
    )
    # Equal titles give equal hits: only the earliest item of each can win.
    titles = names.groupBy("norm").agg(F.min(F.struct("catalog_pos", "item_id")).alias("hit"))
    titles = write_parquet(titles, "titles")
    texts = wanted.select("wanted").distinct()
    equal = titles.join(texts, F.col("norm") == F.col("wanted")).select(
        "wanted", F.lit(False).alias("part"), "hit"
    )
    inside = holding(texts, titles, **options).select("wanted", F.lit(True).alias("part"), "hit")
    best = equal.unionByName(inside).groupBy("wanted").agg(F.min(F.struct("part", "hit")).alias("best"))
    return (
        wanted.join(best, "wanted")
        .groupBy("case_id")
        .agg(F.min(F.struct("candidate_no", "best")).alias("m"))
        .select("case_id", F.col("m.best.hit.item_id").alias("item_id"))
    )
