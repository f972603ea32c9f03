"""Ranked lexical search that scores each class of equal term bags once.

Documents are cut down to the words that items use. What is left of a document, its *bag*, is
the sorted list of (term, occurrences). Documents with equal bags and equal length norm ``m``
score alike for every item, so they form a class:

1. one pass over the texts writes ``doc_id, n, bag`` (words are compared by 64-bit hashes);
2. classes come from grouping by the bag's hash, ``m`` and, as a check, the bag itself;
   partial sums leave one row per class and task, so a hot class needs no task of its own;
3. tasks score classes against all items of a slice and keep the ``k`` best per item, by
   score and then by the class's smallest document id. A class beyond the ``k`` best has ``k``
   documents before it, the smallest of each better class, so it can't be in the result;
4. only the classes kept are expanded, each to its ``k`` smallest ids.

Items are cut into slices of about ``slice_terms`` (item, term) pairs, counted beforehand; a
slice's terms are what is broadcast. Each slice takes a pass of its own over the texts.

Weights are ``floor(1000 ln((2N+2)/(2df+1)))``, the rest is 64-bit integer.

Defined cases: null and empty texts have no terms and are not counted in N. Every row is a
document, so repeated rows take ranks of their own; equal scores go by ascending doc_id, null
ids last. Rows of one item_id form one item with the terms of its distinct texts; items
without id, and items without terms, have no results. Extra columns are ignored. Empty tables
give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.common import byte_set, hashed_words, new_path, saved, text_blocks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_TERM = byte_set(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 20
# (item, term) pairs of a slice: hashes, numbers and places take some 40 bytes each.
SLICE_TERMS = 500_000
BLOCK_BYTES = 1 << 20
# Cells (class, item) and products (class, term, item) held at once by a scoring task.
CELLS = 1 << 20
BAGS = "doc_id bigint, n bigint, bag binary"
BEST = "item int, class bigint, key bigint, m bigint, first_doc bigint, score bigint"


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, repeats`` of all items."""
    lower = F.translate(F.col("text"), UPPER, LOWER)
    texts = items.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    words = texts.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


class Slice:
    """Items of a slice and, per term (by hash, ascending), the items that hold it."""

    def __init__(self, rows):
        self.ids = sorted(rows["item_id"].unique().tolist())
        number = {x: i for i, x in enumerate(self.ids)}
        words = rows["term"].unique().tolist()
        hashes, _ = hashed_words([w.encode() for w in words], IS_TERM)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if len(np.unique(hashes)) < len(words):
            raise ValueError("two terms of a slice share a hash")
        place = {words[j]: t for t, j in enumerate(order.tolist())}
        term = np.array([place[w] for w in rows["term"]], np.int64)
        by_term = np.argsort(term, kind="stable")
        self.items = rows["item_id"].map(number).to_numpy(np.int64)[by_term]
        self.repeats = rows["repeats"].to_numpy(np.int64)[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(len(words) + 1))


def bags(docs: DataFrame, part) -> DataFrame:
    """``doc_id, n, bag`` of every row; ``part`` is a broadcast ``Slice``."""

    def run(batches):
        known = part.value.hashes
        for rows, texts in text_blocks(batches, ["doc_id"], "text", BLOCK_BYTES):
            words, first = hashed_words(texts, IS_TERM)
            place = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = np.flatnonzero(known[place] == words)
            doc = np.searchsorted(first, hit, side="right") - 1
            pair, tf = np.unique(doc * len(known) + place[hit], return_counts=True)
            doc, term = np.divmod(pair, len(known))
            body = np.stack([term, tf], 1).astype("<u4").tobytes()
            ends = 8 * np.searchsorted(doc, np.arange(len(rows) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.Array.from_buffers(
                        pa.binary(),
                        len(rows),
                        [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(body)],
                    ),
                ],
                ["doc_id", "n", "bag"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, BAGS)


def length_norm(docs: int, terms: int) -> Column:
    """``100 - 25 + ((25 n N) div L)``, by integers."""
    return F.expr(f"75 + (25 * n * {docs}L) div {terms}L")


def decoded(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and occurrences of all bags of a batch, and how many pairs each bag has."""
    size = np.diff(np.frombuffer(bag.buffers()[1], "<i4", len(bag) + 1, 4 * bag.offset)) // 8
    start = np.frombuffer(bag.buffers()[1], "<i4", 1, 4 * bag.offset)[0]
    pairs = np.frombuffer(bag.buffers()[2] or b"", "<u4", 2 * int(size.sum()), int(start))
    return pairs[0::2].astype(np.int64), pairs[1::2].astype(np.int64), size


def document_counts(classes: DataFrame, n_terms: int) -> DataFrame:
    """``term, df``: tasks add up their classes' members per term."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            term, _, size = decoded(batch.column("bag"))
            members = batch.column("members").to_numpy(zero_copy_only=False)
            np.add.at(total, term, np.repeat(members, size))
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])

    partial = classes.select("bag", "members").mapInArrow(run, "term bigint, df bigint")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The ``k`` best classes per item seen so far by a task."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.ones(n_items, np.int64)
        self.rows = np.zeros((0, 6), np.int64)

    def add(self, scores: np.ndarray, facts: np.ndarray) -> None:
        """``scores`` of classes by items; ``facts``: class, key, m, smallest id of each."""
        at, item = np.nonzero(scores >= self.floor)
        if not len(at):
            return
        new = np.column_stack([item, facts[at], scores[at, item]])
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort([rows[:, 4], -rows[:, 5], rows[:, 0]])]
        begin = np.searchsorted(rows[:, 0], np.arange(len(self.floor) + 1))
        rank = np.arange(len(rows)) - begin[rows[:, 0]]
        self.rows = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.floor[last[:, 0]] = last[:, 5]


NO_DOC = np.iinfo(np.int64).max


def best_classes(classes: DataFrame, part, weights: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best classes of each item in each task; a score is above 0."""
    context = classes.sparkSession.sparkContext
    sent = context.broadcast(weights)

    def run(batches):
        own, weight = part.value, sent.value
        best = Best(len(own.ids), k)
        fan = np.diff(own.first)
        for batch in batches:
            term, tf, size = decoded(batch.column("bag"))
            facts = np.column_stack(
                [batch.column(c).to_numpy(zero_copy_only=False) for c in ("class", "key", "m", "first")]
            )
            owner = np.repeat(np.arange(len(size)), size)
            value = weight[term] * ((10**9 * tf) // (1000 * tf + 12 * facts[owner, 2]))
            ends = np.concatenate([[0], np.cumsum(size)])
            products = np.concatenate([[0], np.cumsum(fan[term])])[ends]
            a = 0
            while a < len(size):
                # As many classes as the two bounds allow, one at least.
                room = np.searchsorted(products, products[a] + CELLS, side="right") - 1
                b = min(max(a + 1, room), a + max(1, CELLS // len(own.ids)), len(size))
                cells = np.zeros((b - a) * len(own.ids), np.int64)
                for p in range(ends[a], ends[b], CELLS):
                    span = slice(p, min(p + CELLS, ends[b]))
                    times = fan[term[span]]
                    where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    where += np.repeat(own.first[term[span]], times)
                    cell = np.repeat((owner[span] - a) * len(own.ids), times) + own.items[where]
                    np.add.at(cells, cell, np.repeat(value[span], times) * own.repeats[where])
                best.add(cells.reshape(b - a, -1), facts[a:b])
                a = b
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.rows[:, 0], pa.int32()), *[pa.array(best.rows[:, c]) for c in range(1, 6)]],
            ["item", "class", "key", "m", "first_doc", "score"],
        )

    first = F.coalesce("first_doc", F.lit(NO_DOC)).alias("first")
    # Each task returns k rows per item, so their number goes by cores, not by rows.
    few = classes.select("bag", "class", "key", "m", first).coalesce(3 * context.defaultParallelism)
    return few.mapInArrow(run, BEST)


def ranked(keys: list[str], order: list[Column], k: int, name: str = "rank"):
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return lambda df: df.withColumn(name, place).where(F.col(name) <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, slice_terms: int = SLICE_TERMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    wanted = saved(item_terms(items), "item-terms")
    slices = -(-wanted.count() // slice_terms)
    path = new_path(spark, "ranked")
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    totals = None
    for number in range(slices):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == number).toPandas()
        if not len(own):
            continue
        part = spark.sparkContext.broadcast(Slice(own))
        rows = saved(bags(docs, part), "bags")
        if totals is None:
            totals = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if totals[1]:
            found = search_slice(rows, part, *totals, k, kind)
            found.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(path)
        part.unpersist()
    if not totals or not totals[1]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def search_slice(
    rows: DataFrame, part, n_docs: int, n_terms: int, k: int, kind: str
) -> DataFrame:
    """Results for the items of one slice; ``rows`` has the bags of all documents."""
    spark = rows.sparkSession
    own = part.value
    rows = rows.where(F.octet_length("bag") > 0).select(
        F.xxhash64("bag").alias("key"), length_norm(n_docs, n_terms).alias("m"), "bag", "doc_id"
    )
    same = ["key", "m", "bag"]
    classes = rows.groupBy(*same).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members"))
    classes = saved(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    counts = document_counts(classes, len(own.hashes)).select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")
    ).toPandas()
    weights = np.zeros(len(own.hashes), np.int64)
    weights[counts["term"]] = counts["w"]
    best = saved(best_classes(classes, part, weights, k), "best-classes")
    best = saved(ranked(["item"], [F.desc("score"), F.col("first_doc")], k)(best), "top-classes")
    # At most k classes per item of the slice.
    keys = F.broadcast(best.select("key", "m").distinct())
    members = ranked(same, [F.asc_nulls_last("doc_id")], k, "nth")(rows.join(keys, ["key", "m"], "left_semi"))
    bag_of = classes.join(F.broadcast(best.select("class").distinct()), "class", "left_semi").select("class", *same)
    docs_of = members.join(bag_of, same).select("class", "doc_id")
    hits = best.select("item", "class", "score").join(docs_of, "class")
    names = spark.createDataFrame(list(enumerate(own.ids)), f"item int, item_id {kind}")
    return ranked(["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)(hits).join(
        F.broadcast(names), "item"
    )

